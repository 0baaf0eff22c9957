"""Tables whose columns were lost, over the structured pages."""

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import text as X
from lacuna.operators import pages as P
from lacuna.operators import tables as T
from lacuna.workload.standins import STRUCTURED, damaged_pages, filled_sql, finish, sql_text, structured_pages


def _graded(spark, sf_dir):
    return P.grade_pages(structured_pages(spark, sf_dir))


def caption_regions(spark, sf_dir):
    r = T.table_regions(_graded(spark, sf_dir))
    return finish(r.select("document_id", "page_number", "caption", "table_number", "start_line", "end_line"))


def value_rows(spark, sf_dir):
    r = T.table_regions(_graded(spark, sf_dir)).select("document_id", "page_number", "region_index", "value_rows")
    rows = X.unnest(r, "value_rows", "v")
    return finish(rows.select(
        "document_id", "page_number", "region_index", "v.line_number", "v.text",
        F.size("v.values").alias("arity"),
        F.round(F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        "v.has_wide_gap",
    ))


def modal_arity(spark, sf_dir):
    r = T.table_regions(_graded(spark, sf_dir))
    return finish(r.select("document_id", "page_number", "region_index", "modal_arity",
                           F.array_join(F.transform("inconsistent_rows", lambda i: i.cast("string")), ",").alias("inconsistent_rows")))


def table_risk(spark, sf_dir):
    r = T.table_regions(_graded(spark, sf_dir))
    return finish(r.select("document_id", "page_number", "region_index", F.size("value_rows").alias("n_rows"),
                           F.array_join("declared_subcolumns", ",").alias("subcolumns"), "risk", "explanation"))


def page_risk(spark, sf_dir):
    found = T.with_regions(_graded(spark, sf_dir))
    return finish(found.select("document_id", "page_number", T.page_risk(F.col("regions")).alias("risk")))


def risky_tables(spark, sf_dir):
    return finish(T.risky_tables(_graded(spark, sf_dir)).groupBy("document_id", "risk").agg(F.count(F.lit(1)).alias("n")))


def upload_headline(spark, sf_dir):
    graded = _graded(spark, sf_dir)
    coverage = P.coverage_report(graded)
    largest = P.largest_run(P.unreadable_runs(graded))
    found = P.headline(coverage, largest, T.risky_tables(graded))
    return found.select("document_id", F.array_join("findings", " | ").alias("findings"))


def word_arity(spark, sf_dir):
    """Modal number of decimals over the plain texts, whole tables of dotted numbers included."""
    lines = X.unnest(damaged_pages(spark, sf_dir).select("doc_id", X.lines(F.col("original")).alias("l")), "l", "line")
    counted = lines.select("doc_id", F.size(T.decimals(F.col("line"))).alias("arity"))
    return finish(counted.groupBy("arity").agg(F.count(F.lit(1)).alias("lines")))


REGIONS = rf"""{STRUCTURED}, ln AS (
  SELECT doc_id, document_id, page_number, text AS page_text, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM structured)
), caps AS (
  SELECT doc_id, document_id, page_number, line_no AS start_line, line AS caption,
    regexp_extract(line, 'Table\s+([0-9]+)', 1)::BIGINT AS table_number,
    lead(line_no) OVER w AS nxt, row_number() OVER w - 1 AS region_index
  FROM ln WHERE regexp_matches(line, '^\s*Table\s+[0-9]+\s*[:.]\s*.+') WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), last AS (SELECT doc_id, max(line_no) AS last_line FROM ln GROUP BY doc_id
), regions AS (
  SELECT c.*, coalesce(nxt - 1, last_line) AS end_line FROM caps c JOIN last USING (doc_id)
), vals AS (
  SELECT doc_id, line_no, line,
    list_filter(regexp_extract_all(line, '[\p{{L}}\p{{N}}_.]+'), lambda t: regexp_full_match(t, '[0-9]+\.[0-9]+')) AS v,
    regexp_matches(line, '[0-9]\.[0-9]+\s{{2,}}[0-9]+\.[0-9]') AS has_wide_gap FROM ln
), vrows AS (
  SELECT r.doc_id, r.document_id, r.page_number, region_index, line_no AS line_number, trim(line) AS text, len(v) AS arity,
    round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 4) AS total, has_wide_gap
  FROM regions r JOIN vals ON vals.doc_id = r.doc_id AND line_no BETWEEN start_line AND end_line WHERE len(v) >= 2
), sizes AS (
  SELECT r.doc_id, r.region_index, count(arity) AS n_rows FROM regions r LEFT JOIN vrows v
    ON v.doc_id = r.doc_id AND v.region_index = r.region_index GROUP BY ALL
), modes AS (
  SELECT doc_id, region_index, arity AS modal FROM (
    SELECT doc_id, region_index, arity, count(*) AS c, min(line_number) AS f FROM vrows GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, region_index ORDER BY c DESC, f) = 1
), headers AS (
  SELECT r.doc_id, region_index, lower(string_agg(line, chr(10) ORDER BY line_no)) AS header
  FROM regions r JOIN ln ON ln.doc_id = r.doc_id AND line_no BETWEEN start_line AND least(start_line + 11, end_line) GROUP BY ALL
), odd AS (
  SELECT doc_id, region_index, count(*) FILTER (arity <> modal) AS n_odd, count(*) FILTER (arity < modal) AS n_short,
    count(*) FILTER (arity < modal AND has_wide_gap) AS gaps,
    coalesce(string_agg(CASE WHEN arity <> modal THEN line_number::VARCHAR END, ',' ORDER BY line_number), '') AS odd_lines
  FROM vrows JOIN modes USING (doc_id, region_index) GROUP BY ALL
), assessed AS (
  SELECT r.*, n_rows, CASE WHEN n_rows >= 3 THEN modal END AS modal_arity,
    CASE WHEN n_rows >= 3 THEN odd_lines ELSE '' END AS inconsistent_rows, n_odd, n_short, gaps,
    array_to_string(list_filter(['base','total','maximum allowable','allowable against','permissible','minimum'],
      lambda h: contains(header, h)), ',') AS subcolumns
  FROM regions r JOIN sizes USING (doc_id, region_index) JOIN headers USING (doc_id, region_index)
    LEFT JOIN modes USING (doc_id, region_index) LEFT JOIN odd USING (doc_id, region_index)
), risks AS (
  SELECT *, CASE WHEN n_rows < 3 THEN 'none' WHEN n_odd = 0 THEN 'low'
    WHEN subcolumns LIKE '%,%' THEN 'severe' ELSE 'ambiguous_columns' END AS risk FROM assessed)"""

_EXPLAIN = f"""CASE WHEN n_rows < 3 THEN {sql_text(T.WORDING["few"])}
  WHEN n_odd = 0 THEN {filled_sql(T.WORDING["even"], rows="n_rows", modal="modal_arity")}
  ELSE {filled_sql(T.WORDING["odd"], odd="n_odd", rows="n_rows", modal="modal_arity", short="n_short")}
   || CASE WHEN subcolumns <> '' THEN {filled_sql(T.WORDING["named"], named="replace(subcolumns, ',', ', ')")} ELSE '' END
   || CASE WHEN gaps > 0 THEN {filled_sql(T.WORDING["gaps"], gaps="gaps")} ELSE '' END
  END"""

_PAGE_RISK = f"""WITH {REGIONS}
SELECT s.document_id, s.page_number, CASE WHEN bool_or(risk = 'severe') THEN 'severe'
  WHEN bool_or(risk = 'ambiguous_columns') THEN 'ambiguous_columns' WHEN count(risk) > 0 THEN 'low' ELSE 'none' END AS risk
FROM structured s LEFT JOIN risks r USING (doc_id) GROUP BY s.document_id, s.page_number"""

_READABLE_RISKS = """readable_risks AS (
  SELECT risks.* FROM risks JOIN structured s USING (doc_id)
  WHERE risk IN ('ambiguous_columns', 'severe') AND length(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g')) >= 120)"""

_SAID_RUN = filled_sql(P.WORDING["run"], first="a", last="b")
_SAID_UNREAD = filled_sql(P.WORDING["unread"], unread="u", pages="n", run=f"CASE WHEN b > a THEN {_SAID_RUN} ELSE '' END")
_HEADLINE = rf"""WITH {REGIONS}, {_READABLE_RISKS}, pg AS (
  SELECT *, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < {V.MIN_TEXT_CHARS} AS blind FROM structured
), runs AS (
  SELECT document_id, min(page_number) AS a, max(page_number) AS b FROM (
    SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS g FROM pg WHERE blind)
  GROUP BY document_id, g QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY b - a DESC, a) = 1
), cov AS (SELECT document_id, count(*) AS n, count(*) FILTER (blind) AS u FROM pg GROUP BY 1
), tab AS (SELECT document_id, count(*) AS t FROM readable_risks GROUP BY 1
), tp AS (SELECT document_id, string_agg('p. ' || page_number, ', ' ORDER BY page_number) AS p FROM (
    SELECT DISTINCT document_id, page_number FROM readable_risks
    QUALIFY dense_rank() OVER (PARTITION BY document_id ORDER BY page_number) <= 5) GROUP BY 1
), said AS (
  SELECT document_id, array_to_string(list_filter([
    CASE WHEN u > 0 THEN {_SAID_UNREAD} END,
    CASE WHEN t > 0 THEN {filled_sql(P.WORDING["lost"], tables="t", pages="p")} END
  ], lambda x: x IS NOT NULL), ' | ') AS findings
  FROM cov LEFT JOIN runs USING (document_id) LEFT JOIN tab USING (document_id) LEFT JOIN tp USING (document_id))
SELECT document_id, CASE WHEN findings = '' THEN {sql_text(P.WORDING["nothing"])} ELSE findings END AS findings FROM said"""

_WORD_ARITY = rf"""SELECT len(list_filter(regexp_extract_all(line, '[\p{{L}}\p{{N}}_.]+'),
    lambda t: regexp_full_match(t, '[0-9]+\.[0-9]+'))) AS arity, count(*) AS lines
FROM (SELECT unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line FROM documents) GROUP BY 1"""

QUERIES = {
    "caption_regions": (caption_regions, f"WITH {REGIONS} SELECT document_id, page_number, caption, table_number, start_line, end_line FROM regions"),
    "value_rows": (value_rows, f"WITH {REGIONS} SELECT document_id, page_number, region_index, line_number, text, arity, total, has_wide_gap FROM vrows"),
    "modal_arity": (modal_arity, f"WITH {REGIONS} SELECT document_id, page_number, region_index, modal_arity, inconsistent_rows FROM assessed"),
    "table_risk": (table_risk, f"WITH {REGIONS} SELECT document_id, page_number, region_index, n_rows, subcolumns, risk, {_EXPLAIN} AS explanation FROM risks"),
    "page_risk": (page_risk, _PAGE_RISK),
    "risky_tables": (risky_tables, f"WITH {REGIONS}, {_READABLE_RISKS} SELECT document_id, risk, count(*) AS n FROM readable_risks GROUP BY ALL"),
    "upload_headline": (upload_headline, _HEADLINE),
    "decimal_lines": (word_arity, _WORD_ARITY),
}
