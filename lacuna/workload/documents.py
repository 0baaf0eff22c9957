"""Character repair, page grades and document coverage."""

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.operators import pages as P
from lacuna.sources.tables import read_table
from lacuna.workload.standins import (
    DAMAGED, GRADED, PAGES, SUSPECT_SQL, _BAD, _GOOD, damaged_pages, finish, pages, sql_text,
)


def repair_roundtrip(spark, sf_dir):
    df = damaged_pages(spark, sf_dir)
    fixed = X.repaired(F.col("raw_text"))
    unknown = F.when(F.length("raw_text") > F.length("original"), 1).otherwise(0)
    return finish(df.select(
        "doc_id",
        (F.left(fixed, F.length("original")) == F.col("original")).alias("restored"),
        (F.length(fixed) == F.length("raw_text")).alias("length_kept"),
        unknown.alias("unknown_chars"),
        X.substitutions(F.col("raw_text")).alias("substitutions"),
        X.distinct_substitutions(F.col("raw_text")).alias("distinct_substitutions"),
    ))


_DISTINCT = " + ".join(f"contains(raw_text, {sql_text(c)})::BIGINT" for c in V.BAD_CHARS)
_ROUNDTRIP = f"""WITH {DAMAGED}
SELECT doc_id, left(translate(raw_text, {_BAD}, {_GOOD}), length(original)) = original AS restored,
  length(translate(raw_text, {_BAD}, {_GOOD})) = length(raw_text) AS length_kept,
  CASE WHEN length(raw_text) > length(original) THEN 1 ELSE 0 END::BIGINT AS unknown_chars,
  (length(raw_text) - length(translate(raw_text, {_BAD}, '')))::BIGINT AS substitutions,
  {_DISTINCT} AS distinct_substitutions
FROM damaged"""


def page_grade(spark, sf_dir):
    graded = P.grade_pages(damaged_pages(spark, sf_dir))
    return finish(graded.select("document_id", "page_number", "quality", "char_count", "substitutions", "corruption_rate", "caveat"))


_GRADE = f"""WITH {GRADED}
SELECT document_id, page_number, quality, char_count::BIGINT AS char_count, substitutions::BIGINT AS substitutions,
  corruption_rate, CASE quality
  WHEN 'unreadable' THEN 'This page contains no machine-readable text. It is a scan or drawing and must be read by a person.'
  WHEN 'heavily_repaired' THEN 'This page was densely mis-encoded (' || substitutions || ' characters corrected). The quotation is reconstructed, not verbatim.'
  WHEN 'residual_corruption' THEN 'This page contains an encoding fault the pipeline does not fully recognise. Treat the quotation as unreliable and check the source.'
  WHEN 'repaired' THEN substitutions || ' mis-encoded character(s) were corrected on this page. Raw extraction available.' END AS caveat
FROM graded"""


def suspect_histogram(spark, sf_dir):
    graded = P.grade_pages(damaged_pages(spark, sf_dir))
    return P.suspect_histogram(graded).select("codepoint", "occurrences", "pages")


_HISTOGRAM = f"""WITH {GRADED}, found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{SUSPECT_SQL}')) AS ch FROM graded)
SELECT 'U+' || printf('%04X', ascii(ch)) AS codepoint, count(*) AS occurrences, count(DISTINCT doc_id) AS pages
FROM found GROUP BY ch"""


def coverage_report(spark, sf_dir):
    return P.coverage_report(P.grade_pages(damaged_pages(spark, sf_dir)))


_COVERAGE = f"""WITH {GRADED}
SELECT document_id, count(*) AS page_count,
  count(*) FILTER (quality <> 'unreadable') AS readable_page_count,
  count(*) FILTER (quality = 'unreadable') AS unreadable_page_count,
  round(count(*) FILTER (quality <> 'unreadable') / count(*), 4) AS text_coverage,
  sum(char_count)::BIGINT AS total_chars, sum(substitutions)::BIGINT AS total_substitutions,
  count(*) FILTER (substitutions > 0) AS pages_needing_repair,
  {", ".join(f"count(*) FILTER (quality = '{q}') AS n_{q}" for q in V.PAGE_QUALITIES)}
FROM graded GROUP BY document_id"""


def unreadable_runs(spark, sf_dir):
    return P.unreadable_runs(P.grade_pages(damaged_pages(spark, sf_dir)))


_RUNS_CTE = f"""{GRADED}, runs AS (
  SELECT document_id, min(page_number) AS page_start, max(page_number) AS page_end,
    max(page_number) - min(page_number) + 1 AS page_count
  FROM (SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS g
        FROM graded WHERE quality = 'unreadable')
  GROUP BY document_id, g)"""
_RUNS = f"WITH {_RUNS_CTE} SELECT * FROM runs"


def largest_run(spark, sf_dir):
    return P.largest_run(unreadable_runs(spark, sf_dir))


_LARGEST = f"""WITH {_RUNS_CTE}
SELECT document_id, page_start, page_end, page_count FROM runs
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page_count DESC, page_start) = 1"""


def page_lookup(spark, sf_dir):
    """The page that has the number of a benchmark text, in the document the text asks about."""
    wanted = read_table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("document_id"), F.col("item_id").alias("page_number"))
    found = P.page_lookup(P.grade_pages(damaged_pages(spark, sf_dir)), wanted)
    return finish(found.select("item_id", "document_id", "page_number", "quality", "char_count", F.sha2("text", 256).alias("text_digest")))


_LOOKUP = f"""WITH {GRADED}, wanted AS (SELECT item_id, 'src' || (item_id % 20) AS document_id, item_id AS page_number FROM benchmark)
SELECT item_id, w.document_id, w.page_number, quality, char_count, sha256(text) AS text_digest FROM wanted w LEFT JOIN graded g
  ON g.document_id = w.document_id AND g.page_number = w.page_number"""


def coverage_rollup(spark, sf_dir):
    """Pages, documents and the corpus of the damaged pages, with what level each row is of."""
    return finish(P.coverage_rollup(P.grade_pages(damaged_pages(spark, sf_dir))))


_ROLLUP = f"""WITH {GRADED}
SELECT document_id, page_number, grouping(document_id, page_number)::BIGINT AS level, count(*) AS page_count,
  count(*) FILTER (quality <> 'unreadable') AS readable_page_count, round(count(*) FILTER (quality <> 'unreadable') / count(*)::DOUBLE, 4) AS text_coverage,
  sum(char_count)::BIGINT AS total_chars, sum(substitutions)::BIGINT AS total_substitutions, sum(suspects)::BIGINT AS total_suspects, max(corruption_rate) AS worst_corruption_rate
FROM graded GROUP BY ROLLUP (document_id, page_number)"""


def short_text_runs(spark, sf_dir):
    """Islands of low-quality texts, long enough to span several pages."""
    from lacuna.operators.ranges import islands

    marked = pages(spark, sf_dir).where(F.col("n_chars") % 3 != 0)
    return islands(marked, "document_id", "page_number", width=16)


_SHORT = f"""WITH {PAGES}
SELECT document_id, min(page_number) AS page_start, max(page_number) AS page_end
FROM (SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS g
      FROM pages_in WHERE n_chars % 3 <> 0)
GROUP BY document_id, g"""


def numeric_clauses(spark, sf_dir):
    """Measures in metres with their offsets, over all texts of the structured pages."""
    from lacuna.workload.standins import structured_pages

    found = structured_pages(spark, sf_dir).select("doc_id", X.numeric_clauses(F.col("raw_text")).alias("c"))
    return finish(X.unnest(found, "c", "m").select("doc_id", "m.clause", "m.at"))


from lacuna.workload.standins import STRUCTURED  # noqa: E402

# A clause is a maximal word run of 1-4 digits, an optional fraction, then m.
_CLAUSES = rf"""WITH {STRUCTURED}, marked AS (
  SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])([0-9]{{1,4}}(?:\.[0-9]+)?\s?m)([^\p{{L}}\p{{N}}_]|$)',
    '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS m FROM structured),
parts AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS part
  FROM (SELECT doc_id, string_split(m, chr(1)) AS p FROM marked)),
placed AS (SELECT *, coalesce(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at" FROM parts)
SELECT doc_id, string_split(part, chr(2))[1] AS clause, "at" FROM placed WHERE k > 1"""

QUERIES = {
    "repair_roundtrip": (repair_roundtrip, _ROUNDTRIP),
    "page_grade": (page_grade, _GRADE),
    "suspect_histogram": (suspect_histogram, _HISTOGRAM),
    "coverage_report": (coverage_report, _COVERAGE),
    "page_lookup": (page_lookup, _LOOKUP),
    "coverage_rollup": (coverage_rollup, _ROLLUP),
    "unreadable_runs": (unreadable_runs, _RUNS),
    "largest_run": (largest_run, _LARGEST),
    "marked_runs": (short_text_runs, _SHORT),
    "numeric_clauses": (numeric_clauses, _CLAUSES),
}
