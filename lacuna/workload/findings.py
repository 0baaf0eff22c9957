"""Whole findings: every benchmark text asked of the chunked documents, for the place of a nation.

A question's place is the nation of its number; what was measured there meets what the
retrieved passages say, and all of it passes the critic.
"""

import re

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.operators import conflicts as K
from lacuna.operators import search as S
from lacuna.operators.assembly import WORDING
from lacuna.plans import ask
from lacuna.plans.analyse import analyse
from lacuna.workload import reports as R
from lacuna.workload.retrieval import _PASSAGES, _REGIONS, _SPOTS, _chunked
from lacuna.workload.standins import CHUNKS, finish, questions, sql_text
from lacuna.workload.statements import _CLAIM, _INTERPRET

PLACES = 25  # nations


def _findings(spark, sf_dir):
    asked = questions(spark, sf_dir)
    keyed = asked.select(F.col("query_id").cast("string").alias("asked_id"), (F.col("query_id") % PLACES).cast("string").alias("finding_id"))

    def of_questions(df):
        return df.join(keyed, "finding_id").drop("finding_id").withColumnRenamed("asked_id", "finding_id")

    site = of_questions(R.site_statements(spark, sf_dir))
    nearest, _ = R.site_around(spark, sf_dir)
    return analyse(_chunked(spark, sf_dir), asked, site, of_questions(nearest), "Plan", R.WATER_RULE)


def finding_statements(spark, sf_dir):
    """All statements of all findings after review."""
    made = _findings(spark, sf_dir).statements
    return finish(made.select("finding_id", "ordinal", "type", "agent", "text", "page_number", "confidence", "rejected", F.size("critic_notes").alias("n_notes")))


def finding_gaps(spark, sf_dir):
    """What is assumed and what is to be done, with what would settle it."""
    made = _findings(spark, sf_dir).statements.where(F.col("type").isin("assumption", "recommendation") & ~F.col("rejected"))
    return finish(made.select("finding_id", "ordinal", "type", "text", "falsified_by", "responds_to", "priority", "who"))


def finding_conflicts(spark, sf_dir):
    """Where a place and the document, or the document and what could not be read, do not meet."""
    c = _findings(spark, sf_dir).conflicts
    return finish(c.select("finding_id", "ordinal", "kind", "title", "measured_side", "regulatory_side", "resolvability", "severity", "is_decisive",
                           F.array_join("what_would_resolve_it", " | ").alias("resolvers"), F.size("related_statement_ids").alias("n_related")))


def finding_totals(spark, sf_dir):
    """Every finding counted: statements by type, conflicts, unreadable regions, interventions."""
    return finish(_findings(spark, sf_dir).coverage)


def evidence_selections(spark, sf_dir):
    """Which of each question's results can be used, and which have to be looked up."""
    chunked, asked = _chunked(spark, sf_dir), questions(spark, sf_dir)
    found = ask.answer(chunked, asked, V.AGENT_TOP_K)
    return S.selections(asked, ask.evidence(chunked, found.hits), found.blind_spots)


_PASSAGE_REGIONS = r"""runs AS (
  SELECT document_id, min(page_number) AS page_start, max(page_number) AS page_end FROM (
    SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS g FROM chunks WHERE page_quality = 'unreadable')
  GROUP BY document_id, g
), ends AS (
  SELECT document_id, page_number, string_agg(left(t, 260), ' ' ORDER BY chunk_ordinal) AS head, string_agg(right(t, 260), ' ' ORDER BY chunk_ordinal) AS tail
  FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chunks WHERE page_quality <> 'unreadable') GROUP BY ALL
), regions AS (
  SELECT r.*, coalesce(trim(right(b.tail, 260)), '') AS descriptor, coalesce(trim(left(f.head, 200)), '') AS following_context
  FROM runs r LEFT JOIN ends b ON b.document_id = r.document_id AND b.page_number = page_start - 1
    LEFT JOIN ends f ON f.document_id = r.document_id AND f.page_number = page_end + 1)"""
# Chunking has regions of its own, those of tables.
_FOUND = "WITH RECURSIVE " + re.sub(r"\bregions\b", "blind_regions", _SPOTS.replace(_REGIONS, _PASSAGE_REGIONS)).replace(CHUNKS, _PASSAGES, 1).replace("QUALIFY rank <= 8", f"QUALIFY rank <= {V.AGENT_TOP_K}")
_W, _RULE = {k: sql_text(v) for k, v in K.WORDING.items()}, R.WATER_RULE
_A = {k: sql_text(v) for k, v in WORDING.items()}


def _with(words: dict[str, str], key: str, value: str) -> str:
    """A sentence with its {pages} filled in, as SQL."""
    before, after = words[key].split("{pages}")
    return f"{sql_text(before)} || {value} || {sql_text(after)}"


_PAGE_LIST = "array_to_string(list_transform(list_sort(list_distinct(list({}))), lambda p: 'p. ' || p), ', ')"
_DASH = "page_start || chr(8211) || page_end"
HYDRO = f"""), hydro AS (SELECT query_id::VARCHAR AS finding_id, max('nearest mapped watercourse (' || label || ') at ' || round_even(distance_m, 0)::BIGINT || ' m') FILTER (category = 'stream') AS st,
    max('nearest mapped water body (' || label || ') at ' || round_even(distance_m, 0)::BIGINT || ' m') FILTER (category = 'water') AS wa
  FROM questions JOIN nearest ON site = query_id % {PLACES} WHERE category IN ('water', 'stream') GROUP BY 1
"""
_DOCUMENT = rf"""{_FOUND}, ev AS (
  SELECT k.query_id, k.query_id::VARCHAR AS finding_id, k.rank, k.page_number, trim(regexp_replace(c.text, '\s+', ' ', 'g')) AS quote, c.table_caption,
    coalesce(c.table_risk IN ('ambiguous_columns', 'severe'), false) AS risky
  FROM kept k JOIN chunk_rows c ON c.document_id = k.document_id AND c.page_number = k.page_number AND c.char_start = k.chunk_ordinal
), pm AS (
  SELECT *, regexp_replace(quote, '(?i)(^|[^\p{{L}}\p{{N}}_.])([0-9]+(?:\.[0-9]+)?\s*(?:m|metre|meter|sqm|sq\.?\s?m|%|ha))([^\p{{L}}\p{{N}}_]|$)', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS m FROM ev
), pp AS (SELECT * EXCLUDE (p), unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT *, string_split(m, chr(1)) AS p FROM pm)
), pl AS (SELECT *, string_split(part, chr(2))[1] AS whole, sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY query_id, rank ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS s FROM pp
), prov AS (
  SELECT finding_id, page_number, risky, regexp_extract(whole, '[0-9]+(?:\.[0-9]+)?')::DOUBLE AS value,
    lower(replace(replace(regexp_replace(whole, '^[0-9.]+\s*', ''), '.', ''), ' ', '')) AS unit,
    substr(quote, greatest(s - 110, 0) + 1, least(s + length(whole) + 110, length(quote)) - greatest(s - 110, 0)) AS context
  FROM pl WHERE k > 1
), spot AS (
  SELECT query_id::VARCHAR AS finding_id, r.*, page_end - page_start + 1 AS page_count, left(descriptor, {V.SHOWN_CHARS}) AS shown
  FROM ranked r JOIN blind_regions USING (document_id, page_start, page_end) WHERE query_relevant
{HYDRO}), widths AS (SELECT finding_id, string_agg(w, ', ' ORDER BY value) AS w FROM (
    SELECT DISTINCT finding_id, value, regexp_replace(value::VARCHAR, '\.0$', '') || ' m' AS w FROM prov
    WHERE unit = 'm' AND regexp_matches(context, '{V.BUFFER_LANGUAGE}')) GROUP BY 1
), watery AS (SELECT finding_id, least(count(*), {V.RELATED_IDS}) AS n FROM ev
  WHERE regexp_matches(quote, '{V.BUFFER_LANGUAGE}') AND regexp_matches(quote, '{V.WATER_LANGUAGE}') GROUP BY 1
), lost AS (SELECT finding_id, count(*) AS n, {_PAGE_LIST.format("page_number")} AS pages,
    array_to_string(list_sort(list_distinct(list(table_caption))), '; ') AS captions FROM ev WHERE risky GROUP BY 1
), doubtful AS (SELECT finding_id, count(*) AS n, {_PAGE_LIST.format("page_number")} AS pages FROM prov WHERE risky GROUP BY 1
), met AS (
  SELECT w.finding_id, 1 AS ordinal, 'context_vs_regulation' AS kind, {sql_text(_RULE["title"])} AS title,
    'OpenStreetMap places the ' || array_to_string(list_filter([st, wa], lambda x: x IS NOT NULL), ' and the ') || '.' AS measured_side,
    {sql_text(_RULE["regulation"])} || '; ' || coalesce('buffers of ' || w || ' appear in the retrieved provisions', 'buffer provisions apply') || '.' AS regulatory_side,
    'unresolvable_with_open_data' AS resolvability, 1 AS severity, {sql_text(" | ".join(_RULE["resolvers"]))} AS resolvers, w.n AS n_related
  FROM watery w JOIN hydro USING (finding_id) LEFT JOIN widths USING (finding_id)
  UNION ALL
  SELECT finding_id, 2, 'source_vs_source', {_W["table_title"]}, lost.n || ' retrieved passage(s) came from tables on ' || lost.pages || ' whose grid was lost'
    || CASE WHEN doubtful.n > 0 THEN ', including ' || doubtful.n || ' numeric value(s)' ELSE '' END || '.', {_W["table_side"]}, 'resolvable', 2, {_with(K.WORDING, "table_resolver", "lost.pages")}, 0
  FROM lost LEFT JOIN doubtful USING (finding_id)
  UNION ALL
  SELECT finding_id, 10 + rank, 'evidence_vs_absence', page_count || ' page(s) bearing on this question could not be read', {_W["blind_measured"]},
    'Pages ' || {_DASH} || ' carry no machine-readable text.' || CASE WHEN shown <> '' THEN ' Introduced as: ' || chr(8220) || shown || chr(8221) ELSE '' END,
    'resolvable', CASE WHEN page_count > 10 THEN 1 ELSE 2 END, {_with(K.WORDING, "blind_resolver", _DASH)}, 0 FROM spot)"""
# The places' tables come first; both have a table of features found and sites.
_ALL = _DOCUMENT.replace("WITH RECURSIVE ", f"WITH RECURSIVE {R.SITE}, ", 1)
_CONFLICTS = f"""{_ALL}
SELECT finding_id, ordinal, kind, title, measured_side, regulatory_side, resolvability, severity, severity <= 2 AS is_decisive, resolvers, n_related FROM met"""

_WHO, _FIGURE = "'whoever is relying on this answer'", "'whoever is relying on the figure'"
_ENDS = f"""CASE WHEN type <> 'assumption' THEN NULL WHEN ordinal = 200 THEN {_A["centroid_ends"]} WHEN ordinal = 201 THEN {_A["ambiguous_ends"]}
  WHEN ordinal = 230 THEN {_A["drift_ends"]} ELSE {_A["unmapped_ends"]} END"""
_STATED = f"""{_ALL}, said AS (
  SELECT query_id::VARCHAR AS finding_id, ordinal, type, 'site' AS agent, text, NULL::BIGINT AS page_number, proxy_for, CASE WHEN type = 'inference' THEN 'low' END AS confidence,
    {_ENDS} AS falsified_by, NULL::VARCHAR AS responds_to, NULL::BIGINT AS priority, NULL::VARCHAR AS who FROM questions JOIN st ON st.finding_id = (query_id % {PLACES})::VARCHAR
  UNION ALL SELECT finding_id, 300 + rank, 'fact', 'regulation', quote, page_number, NULL, NULL, NULL, NULL, NULL, NULL FROM ev
  UNION ALL SELECT finding_id, 400 + rank, 'assumption', 'regulation', 'Any answer here excludes ' || page_count || ' page(s) (' || {_DASH} ||
      ') that bear on this question but carry no machine-readable text.' || CASE WHEN shown <> '' THEN ' That region is introduced as: ' || chr(8220) || shown || chr(8221) ELSE '' END,
    NULL, NULL, NULL, {_with(WORDING, "blind_ends", _DASH)}, NULL, NULL, NULL FROM spot
  UNION ALL SELECT finding_id, 500 + rank, 'recommendation', 'regulation', {_with(WORDING, "blind_task", _DASH)}, NULL, NULL, NULL, NULL,
    'unreadable document region pp. ' || {_DASH}, CASE WHEN page_count > 5 THEN 1 ELSE 2 END, {_WHO} FROM spot
  UNION ALL SELECT query_id::VARCHAR, 450, 'assumption', 'regulation', {_A["silent"]}, NULL, NULL, NULL, {_A["silent_ends"]}, NULL, NULL, NULL
    FROM questions WHERE query_id NOT IN (SELECT query_id FROM ev)
  UNION ALL SELECT finding_id, 480, 'assumption', 'regulation', {_A["table_lost"]} || CASE WHEN captions <> '' THEN ' (' || captions || ')' ELSE '' END || '. ' || {_A["table_lost_so"]},
    NULL, NULL, NULL, {_with(WORDING, "table_ends", "pages")}, NULL, NULL, NULL FROM lost
  UNION ALL SELECT finding_id, 580, 'recommendation', 'regulation', {_with(WORDING, "table_task", "pages")}, NULL, NULL, NULL, NULL,
    'table column structure lost in extraction', 1, {_FIGURE} FROM lost
  UNION ALL SELECT finding_id, 590, 'recommendation', 'regulation', printf({_A["numbers_task"]}, n, pages), NULL, NULL, NULL, NULL,
    'numeric provisions extracted from unreliable page regions', 1, {_FIGURE} FROM doubtful
  UNION ALL SELECT finding_id, 700, 'assumption', 'conflict', {_W["water_open"]}, NULL, NULL, NULL, {sql_text(_RULE["resolvers"][0])}, NULL, NULL, NULL FROM met WHERE ordinal = 1
  UNION ALL SELECT finding_id, 701, 'recommendation', 'conflict', {sql_text("Obtain " + _RULE["resolvers"][0][0].lower() + _RULE["resolvers"][0][1:])}, NULL, NULL, NULL, NULL,
    {_W["water_task_for"]}, 1, {sql_text(_RULE["who"])} FROM met WHERE ordinal = 1
  UNION ALL SELECT finding_id, 710, 'inference', 'conflict', {_W["standing"]}, NULL, NULL, 'high', NULL, NULL, NULL, NULL FROM ev
    GROUP BY finding_id HAVING bool_or(regexp_matches(quote, '{V.BUFFER_LANGUAGE}') OR regexp_matches(quote, '{V.ZONING_LANGUAGE}'))
), weak AS (SELECT finding_id FROM lost UNION SELECT finding_id FROM spot
), judged AS (
  SELECT *, type = 'fact' AND proxy_for IS NULL AND regexp_matches(text, '{_INTERPRET}') AS moved, regexp_matches(text, '{_CLAIM}') AS over,
    type = 'inference' AND coalesce(confidence IN ('high', 'medium'), false) AND finding_id IN (SELECT finding_id FROM weak) AS capped FROM said)"""
_REVIEWED = f"""{_STATED}
SELECT finding_id, ordinal, CASE WHEN moved THEN 'inference' ELSE type END AS type, CASE WHEN moved THEN 'critic' ELSE agent END AS agent, text,
  CASE WHEN NOT moved THEN page_number END AS page_number, CASE WHEN moved OR capped THEN 'low' ELSE confidence END AS confidence, false AS rejected,
  2 * moved::BIGINT + over::BIGINT + capped::BIGINT AS n_notes FROM judged"""
_GAPS = f"""{_STATED}
SELECT finding_id, ordinal, type, text, falsified_by, responds_to, priority, who FROM judged WHERE type IN ('assumption', 'recommendation')"""
_TOTALS = f"""{_STATED}, counted AS (
  SELECT finding_id, {", ".join(f"count(*) FILTER (CASE WHEN moved THEN 'inference' ELSE type END = '{t}') AS {t}" for t in V.STATEMENT_TYPES)}, 0::BIGINT AS rejected,
    count(*) FILTER (moved OR over OR capped) AS weakened_by_critic, sum(moved::BIGINT + over::BIGINT + capped::BIGINT)::BIGINT AS critic_interventions FROM judged GROUP BY 1
), c AS (SELECT finding_id, count(*) AS conflicts, count(*) FILTER (ordinal = 1) AS unresolvable_conflicts FROM met GROUP BY 1
), u AS (SELECT finding_id, count(*) AS unreadable_regions, sum(page_count)::BIGINT AS unreadable_pages FROM spot GROUP BY 1)
SELECT counted.*, coalesce(conflicts, 0) AS conflicts, coalesce(unresolvable_conflicts, 0) AS unresolvable_conflicts, coalesce(unreadable_regions, 0) AS unreadable_regions,
  coalesce(unreadable_pages, 0) AS unreadable_pages, coalesce(unreadable_regions, 0) = 0 AS evidence_complete
FROM counted LEFT JOIN c USING (finding_id) LEFT JOIN u USING (finding_id)"""

_SELECTED = f"""{_DOCUMENT}
SELECT query_id, coalesce(h.n, 0) AS readable_hits, coalesce(h.r, 0) AS risky_table_hits, coalesce(b.n, 0) AS relevant_blind_spots, coalesce(h.n, 0) > 0 AS has_usable_evidence
FROM questions LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (risky) AS r FROM ev GROUP BY 1) h USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM spot GROUP BY 1) b USING (query_id)"""

QUERIES = {
    "evidence_selections": (evidence_selections, _SELECTED.replace(HYDRO, "", 1)),
    "finding_statements": (finding_statements, _REVIEWED),
    "finding_gaps": (finding_gaps, _GAPS),
    "finding_conflicts": (finding_conflicts, _CONFLICTS),
    "finding_totals": (finding_totals, _TOTALS),
}
