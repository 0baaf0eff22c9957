"""Scoring: labelled documents are the cases, their texts the evidence."""

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.operators import evaluation as E
from lacuna.sources.tables import read_table
from lacuna.workload.standins import CHUNKS, finish, page_chunks

NAMES = [c for c, _ in V.CASE_CHECKS]


def ground_truth_problems(spark, sf_dir):
    k = F.col("item_id")
    cases = read_table(spark, sf_dir, "benchmark").select(
        F.when(k % 10 == 9, k - 1).otherwise(k).alias("case_id"),
        F.concat(F.lit("src"), k % 20).alias("document_id"),
        F.array(k % 60 + 1, k % 7 + 1).alias("expected_pages"),
        F.when(k % 2 == 0, F.element_at(F.split("text", " "), 1)).alias("expected_phrase"),
        F.when(k % 3 == 0, k % 50 + 1).alias("blind_first"),
        F.when(k % 3 == 0, k % 50 + 1 + k % 2).alias("blind_last"),
    )
    pages = page_chunks(spark, sf_dir).withColumn("readable", F.col("page_quality") != "unreadable")
    return E.ground_truth_problems(cases, pages)


_TRUTH = f"""WITH {CHUNKS}, cases AS (
  SELECT CASE WHEN item_id % 10 = 9 THEN item_id - 1 ELSE item_id END AS case_id, 'src' || (item_id % 20) AS document_id,
    [item_id % 60 + 1, item_id % 7 + 1] AS pages, CASE WHEN item_id % 2 = 0 THEN string_split(text, ' ')[1] END AS phrase,
    CASE WHEN item_id % 3 = 0 THEN item_id % 50 + 1 END AS bf, CASE WHEN item_id % 3 = 0 THEN item_id % 50 + 1 + item_id % 2 END AS bl FROM benchmark
), looked AS (
  SELECT c.*, p.text, p.page_quality <> 'unreadable' AS readable
  FROM (SELECT case_id, document_id, phrase, unnest(pages) AS page FROM cases) c LEFT JOIN chunks p ON p.document_id = c.document_id AND p.page_number = c.page
)
SELECT case_id, 'duplicate case id' AS problem FROM cases GROUP BY case_id HAVING count(*) > 1
UNION ALL SELECT case_id, 'page ' || page || ' out of range' FROM looked WHERE readable IS NULL
UNION ALL SELECT case_id, 'expects readable text on page ' || page FROM looked WHERE NOT readable
UNION ALL SELECT case_id, 'phrase not present on the expected pages' FROM looked WHERE phrase IS NOT NULL GROUP BY case_id
  HAVING NOT bool_or(coalesce(readable AND contains(lower(text), lower(phrase)), false))
UNION ALL SELECT DISTINCT case_id, 'expected blind pages are readable' FROM (
  SELECT case_id, document_id, unnest(generate_series(bf, bl)) AS page FROM cases WHERE bf IS NOT NULL) w
  WHERE NOT EXISTS (SELECT 1 FROM chunks p WHERE p.document_id = w.document_id AND p.page_number = w.page AND page_quality = 'unreadable')"""


def _inputs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).withColumn("case_id", F.col("doc_id"))
    k = F.col("doc_id")
    cases = read_table(spark, sf_dir, "labels").select(
        k.alias("case_id"),
        F.when(F.col("quality") == 1, F.array(k % 17 + 1 + k % 2)).otherwise(F.array().cast("array<bigint>")).alias("expected_pages"),
        F.when(F.col("toxic") == 0, "the").alias("expected_phrase"),
        F.when(k % 3 == 0, 5).alias("blind_first"),
        F.when(k % 3 == 0, 7).alias("blind_last"),
        (k % 4 == 1).alias("expect_no_blind_spot"),
        (k % 5 == 0).alias("expect_repair_caveat"),
        (k % 6 == 0).alias("expect_table_risk"),
        (k % 7 == 0).alias("expect_no_evidence"),
        F.when(k % 2 == 0, F.array(F.lit("permitted"), F.lit("the "))).otherwise(F.array().cast("array<string>")).alias("forbidden_phrases"),
    )
    hits = docs.where(k % 7 != 3).withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "case_id", "rank", (k % 17 + F.col("rank")).alias("page_number"), F.col("text").alias("quote"),
        ((k + F.col("rank")) % 5 == 0).alias("text_was_repaired"), F.when(F.col("n_chars") % 6 == 0, "severe").alias("table_risk"))
    reported = docs.where(k % 3 == 0).select("case_id", (5 - k % 2).alias("page_start"), (6 + k % 4).alias("page_end"))
    surface = docs.select("case_id", "text", (F.col("n_chars") % 3 == 0).alias("is_gap"))
    return cases, hits, reported, surface


def case_checks(spark, sf_dir):
    return E.case_checks(*_inputs(spark, sf_dir))


_CHECKS = """checks AS (
  SELECT doc_id AS case_id,
    CASE WHEN quality = 1 THEN doc_id % 7 <> 3 END AS page_recall,
    CASE WHEN quality = 1 THEN doc_id % 7 <> 3 AND doc_id % 2 = 0 END AS page_precision_at_1,
    CASE WHEN toxic = 0 THEN doc_id % 7 <> 3 AND contains(lower(text || ' ' || text), 'the') END AS phrase_found,
    CASE WHEN doc_id % 3 = 0 THEN 5 - doc_id % 2 <= 5 AND 6 + doc_id % 4 >= 7 END AS blind_spot_reported,
    CASE WHEN doc_id % 4 = 1 THEN doc_id % 3 <> 0 END AS no_false_blind_spot,
    CASE WHEN doc_id % 5 = 0 THEN doc_id % 7 <> 3 AND ((doc_id + 1) % 5 = 0 OR (doc_id + 2) % 5 = 0) END AS repair_caveat_present,
    CASE WHEN doc_id % 6 = 0 THEN doc_id % 7 <> 3 AND n_chars % 6 = 0 END AS table_risk_flagged,
    CASE WHEN doc_id % 7 = 0 THEN n_chars % 3 = 0 END AS absence_handled,
    CASE WHEN doc_id % 2 = 0 THEN NOT (contains(lower(text), 'permitted') OR contains(lower(text), 'the ')) END AS no_overclaim
  FROM labels JOIN documents USING (doc_id))"""
_PASSED = " AND ".join(f"coalesce({c}, true)" for c in NAMES)


def interval_containment(spark, sf_dir):
    cases, _, reported, _ = _inputs(spark, sf_dir)
    return E.contained(cases.where(F.col("blind_first").isNotNull()), reported)


def check_tally(spark, sf_dir):
    return E.tally(case_checks(spark, sf_dir), NAMES)


def failed_checks(spark, sf_dir):
    return E.failed_checks(case_checks(spark, sf_dir), NAMES)


def metric_report(spark, sf_dir):
    return E.report(check_tally(spark, sf_dir))


def checks_of_kind(spark, sf_dir):
    """Checked cases of two of four kinds; a label's kind is what it says of the text."""
    kind = F.concat_ws("-", F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("mild"))
    cases = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), kind.alias("kind"))
    kept = E.of_kind(case_checks(spark, sf_dir), cases, ["good-toxic", "poor-mild"])
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"))


def report_counts(spark, sf_dir):
    return E.report_counts(metric_report(spark, sf_dir))


_TALLY = " UNION ALL ".join(
    f"SELECT '{c}' AS \"check\", count(*) FILTER ({c}) AS hits, count({c}) AS total, "
    f"coalesce(round(100 * count(*) FILTER ({c}) / nullif(count({c}), 0), 1), 0.0) AS percent FROM checks" for c in NAMES)
_FAILED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in NAMES) + "], lambda x: x IS NOT NULL), ', ')"
_METRIC = "CASE \"check\" " + " ".join(f"WHEN '{c}' THEN '{m}'" for c, m in V.CASE_CHECKS) + " END"


def latency_quantiles(spark, sf_dir):
    """Median and p95 by index over whole hundredths of event values."""
    e = read_table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return E.indexed_quantiles(e, "event_type", "v")


def value_quantiles(spark, sf_dir):
    """Quartiles, median and p95 by index over event values as they are."""
    e = read_table(spark, sf_dir, "events").select("event_type", "value")
    places = {"least": lambda n: F.lit(0), "q1": lambda n: F.floor(n / 4), "median": lambda n: F.floor(n / 2), "q3": lambda n: F.floor(3 * n / 4), "greatest": lambda n: n - 1}
    return E.order_statistics(e, "event_type", "value", places)


_VALUES = """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, min(v) AS least, max(v) FILTER (i = n // 4) AS q1, max(v) FILTER (i = n // 2) AS median,
  max(v) FILTER (i = 3 * n // 4) AS q3, max(v) AS greatest FROM r GROUP BY event_type"""

_LATENCY = """WITH v AS (SELECT event_type, round(value * 100)::BIGINT AS v FROM events WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM v)
SELECT event_type, count(DISTINCT v) AS distinct_values, max(v) FILTER (i = n // 2) AS median,
  max(v) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95 FROM r GROUP BY event_type"""


def highlight_span(spark, sf_dir):
    """The part of each text a benchmark-long span would mark."""
    docs = read_table(spark, sf_dir, "documents", spread=True)
    h = X.highlight(F.col("text"), (F.col("doc_id") % 300).cast("int"), (F.col("doc_id") % 300 + 200).cast("int"))
    return finish(docs.select("doc_id", h.alias("h")).select(
        "doc_id", F.length("h.before").alias("n_before"), F.col("h.marked").alias("marked"), F.length("h.after").alias("n_after")))


def keyword_limit(spark, sf_dir):
    """First four texts, by id, that mention any of three words: a top-k report."""
    hit = F.contains("text", F.lit("license")) | F.contains("text", F.lit("Email")) | F.contains("text", F.lit("License"))
    return read_table(spark, sf_dir, "documents").where(hit).select("doc_id", "lang", "source").orderBy("doc_id").limit(4)


QUERIES = {
    "ground_truth_problems": (ground_truth_problems, _TRUTH),
    "case_checks": (case_checks, f"WITH {_CHECKS} SELECT *, {_PASSED} AS passed FROM checks"),
    "interval_containment": (interval_containment, f"WITH {_CHECKS} SELECT case_id FROM checks WHERE blind_spot_reported"),
    "check_tally": (check_tally, f"WITH {_CHECKS} {_TALLY}"),
    "failed_checks": (failed_checks, f"WITH {_CHECKS} SELECT * FROM (SELECT case_id, {_FAILED} AS failed FROM checks) WHERE failed <> ''"),
    "metric_report": (metric_report, f"""WITH {_CHECKS}, t AS ({_TALLY})
SELECT {_METRIC} AS name, 'measured' AS status, percent AS value, '%' AS unit, hits AS numerator, total AS denominator, NULL::VARCHAR AS reason_not_measured FROM t
UNION ALL SELECT unnest({V.UNMEASURED_METRICS}), 'not_measured', NULL, '%', NULL, NULL, 'No language model configured; this run generates no prose.'"""),
    "checks_of_kind": (checks_of_kind, f"""WITH {_CHECKS}, k AS (SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END || '-' || CASE WHEN toxic = 1 THEN 'toxic' ELSE 'mild' END AS kind FROM labels)
SELECT kind, count(*) AS cases, count(*) FILTER ({_PASSED}) AS passed FROM checks JOIN k USING (case_id) WHERE kind IN ('good-toxic', 'poor-mild') GROUP BY kind"""),
    "report_counts": (report_counts, f"""WITH {_CHECKS}, t AS ({_TALLY})
SELECT count(*) AS measured, {len(V.UNMEASURED_METRICS)}::BIGINT AS not_measured, count(*) FILTER (percent = 100) AS passed FROM t"""),
    "latency_quantiles": (latency_quantiles, _LATENCY),
    "value_quantiles": (value_quantiles, _VALUES),
    "highlight_span": (highlight_span, """SELECT doc_id, length(substr(text, 1, doc_id % 300))::BIGINT AS n_before,
  CASE WHEN doc_id % 300 >= length(text) THEN '' ELSE substr(text, doc_id % 300 + 1, 200) END AS marked, greatest(length(text) - (doc_id % 300 + 200), 0)::BIGINT AS n_after FROM documents"""),
    "keyword_limit": (keyword_limit, "SELECT doc_id, lang, source FROM documents WHERE contains(text, 'license') OR contains(text, 'License') OR contains(text, 'Email') ORDER BY doc_id LIMIT 4"),
}
