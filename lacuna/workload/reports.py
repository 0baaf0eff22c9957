"""Conflicts, comparison of sites, panels and coverage figures.

In conflict queries every page is one finding: its segments are the claims.
Nations are the sites compared.
"""

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import places as LP
from lacuna.functions import text as X
from lacuna.operators import assembly as A
from lacuna.operators import chunks as C
from lacuna.operators import conflicts as K
from lacuna.operators import critic as R
from lacuna.operators import geography as G
from lacuna.operators import pages as P
from lacuna.operators import reports as O
from lacuna.operators import search as S
from lacuna.operators.statements import statement
from lacuna.session import materialise
from lacuna.sources.tables import read_table
from lacuna.workload import geography as geo
from lacuna.workload import statements as ST
from lacuna.workload.passages import SEGMENTS
from lacuna.workload.retrieval import _PROVISIONS
from lacuna.workload.standins import filled_sql, finish, pages, sql_text, structured_pages


def _finding_id():
    return F.concat_ws(":", "document_id", F.col("page_number").cast("string"))


def _spots(spark, sf_dir):
    """Unreadable regions of the pages' findings, made from page numbers and lengths alone."""
    return pages(spark, sf_dir).where(F.col("page_number") % 5 == 0).select(
        _finding_id().alias("finding_id"), F.lit(1).alias("rank"), F.col("page_number").alias("page_start"),
        (F.col("page_number") + F.col("n_chars") % 15).alias("page_end"), (F.col("n_chars") % 15 + 1).alias("page_count"),
        F.lit("Annexure").alias("descriptor"))


def _sides(spark, sf_dir):
    # Numbered once for both readers of the text.
    graded = P.grade_pages(materialise(structured_pages(spark, sf_dir)))
    laid = C.with_segments(graded).select(_finding_id().alias("finding_id"), "doc_id", "segments")
    claims = X.unnest(laid, "segments", "s").select(
        "finding_id", F.col("s.at").alias("ordinal"), F.concat_ws("_", F.lit("c"), "doc_id", "s.at").alias("id"), F.col("s.cleaned").alias("text"))
    risk = F.when(F.col("page_number") % 4 == 0, "severe")
    evidence = graded.select(_finding_id().alias("finding_id"), "page_number", "text",
                             (F.col("page_number") % 3 == 0).alias("text_was_repaired"), risk.alias("table_risk"))
    # Compact next to the pages and read by three rules.
    provisions = materialise(S.numeric_provisions(evidence, ["finding_id", "page_number"]))
    raw = pages(spark, sf_dir)
    kinds = F.array_compact(F.array(
        F.when(F.col("page_number") % 2 == 0, F.struct(F.lit("stream").alias("category"), F.lit("unnamed stream").alias("label"), (F.col("n_chars") / 7.0).alias("distance_m"))),
        F.when(F.col("page_number") % 3 == 0, F.struct(F.lit("water").alias("category"), F.format_string("Lake %d", "page_number").alias("label"), (F.col("n_chars") / 3.0).alias("distance_m"))),
    ))
    nearest = raw.select(_finding_id().alias("finding_id"), F.explode(kinds).alias("k")).select("finding_id", "k.*")
    return claims, provisions, nearest, evidence, _spots(spark, sf_dir)


def _conflicts(spark, sf_dir):
    return K.all_conflicts(*_sides(spark, sf_dir), WATER_RULE)


def conflict_rules(spark, sf_dir):
    c = _conflicts(spark, sf_dir)
    return finish(c.select("finding_id", "kind", "title", "measured_side", "regulatory_side", "resolvability", "severity",
                           F.array_join("related_statement_ids", ",").alias("related"), F.size("what_would_resolve_it").alias("n_resolvers")))


def conflicts_sorted(spark, sf_dir):
    from lacuna.operators.ranges import rank_rows

    ranked = rank_rows(_conflicts(spark, sf_dir), "finding_id", [("severity", False)], "ordinal", "position")
    return finish(ranked.select("finding_id", "position", "severity", "title", "is_decisive"))


def conflict_statements(spark, sf_dir):
    claims, provisions, nearest, evidence, spots = _sides(spark, sf_dir)
    made = K.conflict_statements(claims, K.all_conflicts(claims, provisions, nearest, evidence, spots, WATER_RULE), WATER_RULE)
    return finish(made.select("finding_id", "ordinal", "type", F.array_join("derived_from", ",").alias("derived_from"), "priority", "confidence"))


#: A neutral rule about water, as a jurisdiction would word its own.
WATER_RULE = {
    "title": "How far water is says nothing yet about the strip along it",
    "regulation": "Building is restricted along water",
    "why": "Within the strip hardly anything may be built.",
    "blocking": ["The map does not say how wide the strip is here.", "The strip starts at a bank that only a survey shows."],
    "resolvers": ["The official map of strips along water.", "A survey of the bank.", "The outline of the plot."],
    "who": "the office that keeps the map",
}
_SIDES = rf"""{SEGMENTS}, claims AS (
  SELECT document_id || ':' || page_number AS finding_id, b AS ordinal, 'c_' || doc_id || '_' || b AS id, segment AS text FROM segs
), watery AS (
  SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ordinal) AS k FROM claims
  WHERE regexp_matches(text, '{V.BUFFER_LANGUAGE}') AND regexp_matches(text, '{V.WATER_LANGUAGE}')
), related AS (SELECT finding_id, string_agg(id, ',' ORDER BY k) AS related FROM watery WHERE k <= 3 GROUP BY 1
), prov AS (SELECT document_id || ':' || page_number AS finding_id, * FROM ({_PROVISIONS})
), widths AS (SELECT finding_id, string_agg(w, ', ' ORDER BY value) AS w FROM (
    SELECT DISTINCT finding_id, value, regexp_replace(value::VARCHAR, '\.0$', '') || ' m' AS w FROM prov
    WHERE unit = 'm' AND regexp_matches(context, '{V.BUFFER_LANGUAGE}')) GROUP BY 1
), pn AS (SELECT document_id || ':' || page_number AS finding_id, * FROM pages_in
), near AS (SELECT finding_id,
    CASE WHEN page_number % 2 = 0 THEN 'nearest mapped watercourse (unnamed stream) at ' || round_even(n_chars / 7.0::DOUBLE, 0)::BIGINT || ' m' END AS st,
    CASE WHEN page_number % 3 = 0 THEN 'nearest mapped water body (Lake ' || page_number || ') at ' || round_even(n_chars / 3.0::DOUBLE, 0)::BIGINT || ' m' END AS wa
  FROM pn WHERE page_number % 2 = 0 OR page_number % 3 = 0
), found AS (
  SELECT r.finding_id, 1 AS ordinal, 'context_vs_regulation' AS kind, '{WATER_RULE["title"]}' AS title,
    'OpenStreetMap places the ' || array_to_string(list_filter([st, wa], lambda x: x IS NOT NULL), ' and the ') || '.' AS measured_side,
    '{WATER_RULE["regulation"]}; ' || coalesce('buffers of ' || w || ' appear in the retrieved provisions', 'buffer provisions apply') || '.' AS regulatory_side,
    'unresolvable_with_open_data' AS resolvability, 1 AS severity, related, 3 AS n_resolvers
  FROM related r JOIN near USING (finding_id) LEFT JOIN widths USING (finding_id)
  UNION ALL
  SELECT p.finding_id, 2, 'source_vs_source', '{K.WORDING["table_title"]}',
    '1 retrieved passage(s) came from tables on p. ' || p.page_number || ' whose grid was lost' ||
      CASE WHEN count(v.value) > 0 THEN ', including ' || count(v.value) || ' numeric value(s)' ELSE '' END || '.',
    '{K.WORDING["table_side"]}', 'resolvable', 2, '', 1
  FROM pn p LEFT JOIN prov v ON v.finding_id = p.finding_id WHERE p.page_number % 4 = 0 GROUP BY p.finding_id, p.page_number
  UNION ALL
  SELECT finding_id, 3, 'source_vs_source', '{K.WORDING["repaired_title"]}',
    count(*) || ' value(s) on p. ' || page_number || ' came from text that extracted incorrectly and was repaired.',
    '{K.WORDING["repaired_side"]}', 'resolvable', 3, '', 1
  FROM prov WHERE page_number % 3 = 0 GROUP BY finding_id, page_number
  UNION ALL
  SELECT finding_id, 11, 'evidence_vs_absence', (n_chars % 15 + 1) || ' page(s) bearing on this question could not be read',
    '{K.WORDING["blind_measured"]}',
    'Pages ' || page_number || chr(8211) || (page_number + n_chars % 15) || ' carry no machine-readable text. Introduced as: ' || chr(8220) || 'Annexure' || chr(8221),
    'resolvable', CASE WHEN n_chars % 15 + 1 > 10 THEN 1 ELSE 2 END, '', 1
  FROM pn WHERE page_number % 5 = 0)"""
_ZONED = f"""zoned AS (SELECT finding_id FROM claims GROUP BY 1 HAVING bool_or(regexp_matches(text, '{V.BUFFER_LANGUAGE}') OR regexp_matches(text, '{V.ZONING_LANGUAGE}'))),
parents AS (SELECT finding_id, string_agg(id, ',' ORDER BY ordinal) AS p FROM (
  SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ordinal) <= 3) GROUP BY 1)"""


def _conflict_sites(spark, sf_dir):
    """Conflicts with their document as the comparison and the page as the site."""
    c = _conflicts(spark, sf_dir)
    return c.withColumn("comparison", F.substring_index("finding_id", ":", 1)).withColumn(
        "site_order", F.substring_index("finding_id", ":", -1).cast("long"))


def critical_question(spark, sf_dir):
    sites = pages(spark, sf_dir).select(F.col("document_id").alias("comparison"), F.col("page_number").alias("site"))
    return finish(O.critical_question(_conflict_sites(spark, sf_dir), sites))


_CRITICAL = f"""WITH {_SIDES}, n AS (SELECT document_id AS comparison, count(*) AS n_sites FROM pages_in GROUP BY 1),
o AS (SELECT split_part(finding_id, ':', 1) AS comparison, count(*) AS unresolvable FROM found WHERE severity = 1 AND kind = 'context_vs_regulation' GROUP BY 1)
SELECT comparison, n_sites, coalesce(unresolvable, 0) AS unresolvable, CASE
  WHEN unresolvable >= n_sites THEN {filled_sql(O.WORDING["everywhere"], title=f"lower({sql_text(WATER_RULE['title'])})", resolver=sql_text(WATER_RULE["resolvers"][0]))}
  WHEN unresolvable > 0 THEN {filled_sql(O.WORDING["somewhere"], n="unresolvable")}
  ELSE {sql_text(O.WORDING["nowhere"])} END AS critical_question
FROM n LEFT JOIN o USING (comparison)"""


def change_my_mind(spark, sf_dir):
    listed = O.change_my_mind(ST.made(spark, sf_dir), _conflicts(spark, sf_dir))
    return listed.groupBy("finding_id", "would_change_if", "origin").agg(F.count(F.lit(1)).alias("n"))


_RESOLVERS = "[" + ", ".join(f"'{r}'" for r in WATER_RULE["resolvers"]) + "]"
_MIND = f"""WITH {_SIDES}, {ST.MADE}
SELECT finding_id, CASE WHEN n % 10 = 0 THEN '' ELSE 'A survey.' END AS would_change_if, 'assumption' AS origin, count(*) AS n FROM made WHERE type = 'assumption' GROUP BY ALL
UNION ALL
SELECT finding_id, r, 'conflict', count(*) FROM (
  SELECT finding_id, unnest(CASE WHEN ordinal = 1 THEN {_RESOLVERS}
    WHEN ordinal = 2 THEN ['A look at the table as printed on p. ' || split_part(finding_id, ':', 2) || '.']
    WHEN ordinal = 3 THEN ['A look at the figure as printed on p. ' || split_part(finding_id, ':', 2) || '.']
    ELSE [split_part(regulatory_side, ' carry', 1) AS x] END) AS r FROM found WHERE ordinal <> 11
  UNION ALL SELECT finding_id, 'A reading of ' || lower(left(split_part(regulatory_side, ' carry', 1), 1)) || substr(split_part(regulatory_side, ' carry', 1), 2) || '.' FROM found WHERE ordinal = 11
) GROUP BY ALL""".replace("[split_part(regulatory_side, ' carry', 1) AS x]", "['']")


def verify_next(spark, sf_dir):
    return finish(O.verify_next(ST.made(spark, sf_dir)).select("finding_id", "id", "priority", "queue_position"))


def finding_coverage(spark, sf_dir):
    reviewed = ST.reviewed(spark, sf_dir)
    conflicts = _conflict_sites(spark, sf_dir).withColumn("finding_id", F.col("comparison"))
    spots = _spots(spark, sf_dir).withColumn("finding_id", F.substring_index("finding_id", ":", 1))
    return finish(O.finding_coverage(reviewed, conflicts, spots, R.findings(reviewed)))


_COVER = f"""WITH {_SIDES}, {ST.NOTES}, s AS (
  SELECT finding_id, {", ".join(f"count(*) FILTER (NOT n_sourced AND type = '{t}') AS {t}" for t in V.STATEMENT_TYPES)},
    count(*) FILTER (n_sourced) AS rejected, count(*) FILTER (n_sourced OR n_quoted OR n_proxied OR n_capped OR n_over) AS weakened_by_critic,
    sum(n_sourced::BIGINT + n_quoted::BIGINT + n_proxied::BIGINT + n_capped::BIGINT + n_over::BIGINT)::BIGINT AS critic_interventions
  FROM noted GROUP BY finding_id),
c AS (SELECT split_part(finding_id, ':', 1) AS finding_id, count(*) AS conflicts, count(*) FILTER (ordinal = 1) AS unresolvable_conflicts FROM found GROUP BY 1),
u AS (SELECT document_id AS finding_id, count(*) AS unreadable_regions, sum(n_chars % 15 + 1)::BIGINT AS unreadable_pages FROM pages_in WHERE page_number % 5 = 0 GROUP BY 1)
SELECT s.*, coalesce(conflicts, 0) AS conflicts, coalesce(unresolvable_conflicts, 0) AS unresolvable_conflicts, coalesce(unreadable_regions, 0) AS unreadable_regions,
  coalesce(unreadable_pages, 0) AS unreadable_pages, coalesce(unreadable_regions, 0) = 0 AS evidence_complete
FROM s LEFT JOIN c USING (finding_id) LEFT JOIN u USING (finding_id)"""


# --- sites -----------------------------------------------------------------------

def _nations(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("site"),
        (12.85 + F.col("n_nationkey") * 0.008).alias("latitude"),
        (77.50 + F.col("n_nationkey") * 0.008).alias("longitude"),
    )


PLACE_TYPES = ["station", "suburb", "city"]
#: All nations lie in one cell of the climate grid, which reads this station.
STATION = "1-URGENT"
CLIMATE_SOURCE = {"provider": "archive", "endpoint": "(recorded)", "licence": "CC-BY", "limitation": "A grid of about 9 km."}


def provided(df, source):
    return df.withColumns({k: F.lit(v) for k, v in source.items()} | {"retrieved_at": F.lit("2024-05-01").cast("timestamp")})


def _resolved(spark, sf_dir):
    """Every nation as a resolved place name, with what a geocoder says of it."""
    n = F.col("n_nationkey")
    place = F.element_at(F.array(*[F.lit(t) for t in PLACE_TYPES]), (n % 3 + 1).cast("int"))
    found = read_table(spark, sf_dir, "nation").select(
        n.cast("string").alias("finding_id"), F.col("n_name").alias("query"), (12.85 + n * 0.008).alias("latitude"), (77.50 + n * 0.008).alias("longitude"),
        F.concat_ws(", ", "n_name", F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("display_name"), place.alias("place_type"),
        LP.is_area_centroid(place).alias("is_area_centroid"), (n % 4 * 0.5).alias("extent_km"), (n % 5 == 0).alias("is_ambiguous"),
        (n % 3 + 2).alias("candidates"), F.concat_ws("; ", "n_name", F.lit("elsewhere")).alias("names"))
    return provided(found, {"provider": "geocoder", "endpoint": "(recorded)", "licence": "ODbL", "limitation": "Names are looked up, plots are not."})


def _terrain(spark, sf_dir):
    points = G.sample_points(_nations(spark, sf_dir))
    elevation = F.when((F.col("site") + F.col("position")) % 13 != 0, 900.0 + (F.col("site") * 31 + F.col("position") * 17) % 23)
    found = G.terrain(points.withColumn("elevation_m", elevation)).withColumn("finding_id", F.col("site").cast("string"))
    return provided(found, CLIMATE_SOURCE)


def _climate(spark, sf_dir):
    days = geo.daily(spark, sf_dir).where(F.col("site") == STATION)
    span = days.groupBy("site").agg(F.min("day").cast("string").alias("start_date"), F.max("day").cast("string").alias("end_date"))
    read = G.climate_summary(days).join(span, "site").withColumn("grid_drift_km", F.lit(2.5)).drop("site")
    # One row beside every nation.
    keyed = _nations(spark, sf_dir).select(F.col("site").cast("string").alias("finding_id"), F.lit(STATION).alias("station"))
    return provided(keyed.join(read.withColumn("station", F.lit(STATION)), "station").drop("station"), CLIMATE_SOURCE)


def site_around(spark, sf_dir):
    """Each nation's nearest features and counts, by finding_id."""
    sites = _nations(spark, sf_dir)
    around = G.features_around(sites, geo.features(spark, sf_dir))
    fid = F.col("site").cast("string")
    nearest = G.nearest_features(sites, geo.features(spark, sf_dir)).select(fid.alias("finding_id"), "category", "label", "distance_m")
    return nearest, G.category_counts(sites, around).select(fid.alias("finding_id"), "category", "n")


def site_statements(spark, sf_dir):
    """All that is stated about every nation's place: where it is, what is near, rain and terrain."""
    made_by = _nations(spark, sf_dir).select(
        F.col("site").cast("string").alias("finding_id"), F.lit("overpass").alias("provider"), F.lit("(recorded)").alias("endpoint"),
        F.lit("2024-05-01").cast("timestamp").alias("retrieved_at"), F.lit("ODbL").alias("licence"), F.lit("Crowd-sourced.").alias("limitation"))
    nearest, counts = site_around(spark, sf_dir)
    return A.union_all([
        A.location_statements(_resolved(spark, sf_dir)), A.nearest_statements(made_by, nearest), A.density_statements(made_by, counts),
        A.climate_statements(_climate(spark, sf_dir)), A.terrain_statements(_terrain(spark, sf_dir))])


def _site_facts(spark, sf_dir):
    return O.context(site_statements(spark, sf_dir)).withColumn("site", F.col("finding_id"))


def site_reading(spark, sf_dir):
    return finish(site_statements(spark, sf_dir).select("finding_id", "ordinal", "type", "text", "proxy_for", "limitation"))


def _cells(spark, sf_dir):
    return O.comparison_cells(_site_facts(spark, sf_dir), _nations(spark, sf_dir).select(F.col("site").cast("string").alias("site")))


def comparison_cells(spark, sf_dir):
    return finish(_cells(spark, sf_dir).select("site", "dimension", "label", "value", "established", "proxy_for"))


def comparison_matrix(spark, sf_dir):
    # The 25 nations of the schema are the columns.
    return finish(O.comparison_matrix(_cells(spark, sf_dir), [str(i) for i in range(25)]))


def differentiating_rows(spark, sf_dir):
    return O.comparison_rows(_cells(spark, sf_dir)).drop("row_order")


def site_coverage(spark, sf_dir):
    page = pages(spark, sf_dir).select((F.col("page_number") % 25).cast("string").alias("finding_id"), F.col("page_number").alias("ordinal"), "raw_text")
    passages = statement(page, "fact", "regulation", text=F.col("raw_text"), source_kind="document")
    s = site_statements(spark, sf_dir).unionByName(passages).withColumn("site", F.col("finding_id"))
    nothing = _conflict_sites(spark, sf_dir).withColumn("site", (F.col("site_order") % 25).cast("string"))
    spots = _spots(spark, sf_dir).withColumn("site", (F.col("page_start") % 25).cast("string"))
    return finish(O.site_coverage(s, nothing, spots, _cells(spark, sf_dir)))


def site_panels(spark, sf_dir):
    facts = O.context(site_statements(spark, sf_dir))
    findings = _nations(spark, sf_dir).select(F.col("site").cast("string").alias("finding_id"))
    shown = O.site_panels(facts, findings)
    texts = F.array_join(F.transform("statements", lambda f: f["text"]), " | ")
    return finish(shown.select("finding_id", "panel", "facts", "limitation", "available", texts.alias("texts")))


def map_features(spark, sf_dir):
    around = G.features_around(_nations(spark, sf_dir), geo.tagged(spark, sf_dir).where(F.col("category").isNotNull()))
    shown = O.map_features(around.withColumn("osm_type", F.lit("node")).withColumn("osm_id", F.col("feature_id")))
    return shown.groupBy("osm_id", "label", "osm_url", F.array_join(F.map_keys("tags"), ",").alias("tag_keys")).agg(F.count(F.lit(1)).alias("n"))


_NATIONS = geo.AROUND.replace(
    f"SELECT s_suppkey AS site, {geo._SLAT} AS slat, {geo._SLON} AS slon FROM supplier",
    "SELECT n_nationkey::BIGINT AS site, 12.85::DOUBLE + n_nationkey * 0.008::DOUBLE AS slat, 77.50::DOUBLE + n_nationkey * 0.008::DOUBLE AS slon FROM nation")
_PROX = "(VALUES " + ", ".join(f"({10 + i}, '{c}', '{p}')" for i, (c, p) in enumerate(V.PROXIES)) + ") AS p(ordinal, category, proxy)"
_ORDER = "list_position([" + ", ".join(f"'{c}'" for c in V.CATEGORIES) + "], category)"
CLIMATE_SQL = f"""WITH {geo.DAILY}, y AS (SELECT site, count(*) AS years, round(avg(t), 1) AS mean FROM (
    SELECT site, strftime(day, '%Y') AS year, sum(mm::DECIMAL(18,1))::DOUBLE AS t FROM daily GROUP BY ALL) GROUP BY site),
p AS (SELECT site, round(mm, 1) AS peak, day FROM daily QUALIFY row_number() OVER (PARTITION BY site ORDER BY mm DESC, day) = 1),
s AS (SELECT site, min(day) AS a, max(day) AS z, count(*) FILTER (mm >= 50) AS n FROM daily GROUP BY site)
SELECT site AS finding_id, 30::BIGINT AS ordinal, 'fact' AS type, 'Mean annual precipitation ' || mean || ' mm across ' || years || ' years (' || a || ' to ' || z || ').' AS text,
  'rainfall exposure at the site' AS proxy_for, '{CLIMATE_SOURCE["limitation"]}' AS limitation FROM y JOIN s USING (site)
UNION ALL SELECT site, 31, 'fact', 'Peak recorded daily rainfall ' || peak || ' mm on ' || day || '; ' || n || ' day(s) above 50 mm in the period.',
  'intensity of extreme rainfall events', '{CLIMATE_SOURCE["limitation"]}' FROM p JOIN s USING (site)
UNION ALL SELECT site, 230, 'assumption', 'Climate values describe an ERA5 grid cell 2.5 km from the site, not the site itself.', NULL, NULL FROM s"""
_GROUND = geo._TERRAIN.replace("FROM supplier", "FROM nation").replace(geo._SLAT, "(12.85::DOUBLE + n_nationkey * 0.008::DOUBLE)").replace(
    geo._SLON, "(77.50::DOUBLE + n_nationkey * 0.008::DOUBLE)").replace("s_suppkey AS site", "n_nationkey::BIGINT AS site")
_AREAS = "(" + ", ".join(f"'{t}'" for t in V.AREA_PLACE_TYPES) + ")"
SITE = f"""{_NATIONS}, {geo.COUNTS}, ground AS ({_GROUND}), located AS (
  SELECT *, place IN {_AREAS} AS area FROM (
    SELECT n_nationkey::BIGINT AS n, n_nationkey::VARCHAR AS k, n_name AS name, n_regionkey AS region, 12.85::DOUBLE + n_nationkey * 0.008::DOUBLE AS lat,
      77.50::DOUBLE + n_nationkey * 0.008::DOUBLE AS lon, {PLACE_TYPES}[n_nationkey % 3 + 1] AS place, (n_nationkey % 4) * 0.5::DOUBLE AS extent FROM nation)
), st AS (
  SELECT s.site::VARCHAR AS finding_id, CASE WHEN distance_m IS NULL THEN 200 ELSE 0 END + ordinal AS ordinal, CASE WHEN distance_m IS NULL THEN 'assumption' ELSE 'fact' END AS type,
    CASE WHEN distance_m IS NULL THEN 'No ' || replace(p.category, '_', ' ') || ' is mapped within the search radius. This is not evidence that none exists.'
      ELSE 'Nearest mapped ' || replace(p.category, '_', ' ') || ': ' || label || ' at ' || round_even(distance_m, 0)::BIGINT || ' m (straight-line).' END AS text,
    CASE WHEN distance_m IS NOT NULL THEN proxy END AS proxy_for, CASE WHEN distance_m IS NOT NULL THEN 'Crowd-sourced.' END AS limitation
  FROM sites s CROSS JOIN {_PROX} LEFT JOIN nearest n ON n.site = s.site AND n.category = p.category
  UNION ALL
  SELECT k, 0, 'fact', chr(8220) || name || chr(8221) || ' resolves to ' || printf('%.6f', lat) || ', ' || printf('%.6f', lon) || ' ' || chr(8212) || ' ' || name || ', region ' || region || '.',
    CASE WHEN area THEN 'the location of the site under consideration' END, 'Names are looked up, plots are not.' FROM located
  UNION ALL
  SELECT k, 200, 'assumption', 'All measurements below describe the centroid of ' || place || ' ' || chr(8220) || name || chr(8221) ||
    CASE WHEN extent <> 0 THEN ', an area spanning roughly ' || extent || ' km' ELSE '' END || ', not a specific plot.', NULL, NULL FROM located WHERE area
  UNION ALL
  SELECT k, 201, 'assumption', chr(8220) || name || chr(8221) || ' matched ' || (n % 3 + 2) || ' distinct locations (' || name || '; elsewhere). The highest-ranked was used.', NULL, NULL
  FROM located WHERE n % 5 = 0
  UNION ALL
  SELECT k, c.ordinal, c.type, c.text, c.proxy_for, c.limitation FROM located CROSS JOIN ({CLIMATE_SQL}) c WHERE c.finding_id = '{STATION}'
  UNION ALL
  SELECT site::VARCHAR, 40, 'fact', 'Site elevation ' || site_elevation_m || ' m; local relief ' || local_relief_m || ' m across sampled points within {V.SAMPLE_RADIUS_M} m.',
    'position within the local catchment', '{CLIMATE_SOURCE["limitation"]}' FROM ground
  UNION ALL
  SELECT site::VARCHAR, 100, 'inference', position_description, NULL, NULL FROM ground
  UNION ALL
  SELECT site::VARCHAR, 20, 'fact', sum(n) || ' features mapped near this point: ' || string_agg(n || ' ' || replace(category, '_', ' '), ', ' ORDER BY {_ORDER}) || '.',
    'density and maturity of surrounding development', 'Crowd-sourced.' FROM counts GROUP BY site)"""
_DIMS = "(VALUES " + ", ".join(f"({i}, '{k}', '{l}', '{w[0]}')" for i, (k, l, w) in enumerate(V.DIMENSIONS)) + ") AS d(row_order, dimension, label, keyword)"
_CELLS = f"""{SITE}, cells AS (
  SELECT s.site::VARCHAR AS site, d.dimension, d.label, d.row_order, arg_min(f.text, f.ordinal) AS value, arg_min(f.proxy_for, f.ordinal) AS proxy_for,
    count(f.text) > 0 AS established
  FROM sites s CROSS JOIN {_DIMS} LEFT JOIN st f ON f.finding_id = s.site::VARCHAR AND f.type = 'fact' AND contains(lower(f.text), keyword)
  GROUP BY ALL)"""
_PANEL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in V.PANELS) + " END"
_PANELS = "(VALUES " + ", ".join(f"('{k}')" for k in [k for k, _ in V.PANELS] + ["constraints"]) + ") AS p(panel)"

QUERIES = {
    "conflict_rules": (conflict_rules, f"WITH {_SIDES} SELECT finding_id, kind, title, measured_side, regulatory_side, resolvability, severity, related, n_resolvers FROM found"),
    "conflicts_sorted": (conflicts_sorted, f"WITH {_SIDES} SELECT finding_id, row_number() OVER (PARTITION BY finding_id ORDER BY severity, ordinal) AS position, severity, title, severity <= 2 AS is_decisive FROM found"),
    "conflict_statements": (conflict_statements, f"""WITH {_SIDES}, {_ZONED}
SELECT finding_id, 700 AS ordinal, 'assumption' AS type, NULL::VARCHAR AS derived_from, NULL::BIGINT AS priority, NULL::VARCHAR AS confidence FROM found WHERE ordinal = 1
UNION ALL SELECT finding_id, 701, 'recommendation', NULL, 1, NULL FROM found WHERE ordinal = 1
UNION ALL SELECT finding_id, 710, 'inference', p, NULL, 'high' FROM zoned JOIN parents USING (finding_id)"""),
    "change_my_mind": (change_my_mind, _MIND),
    "verify_next": (verify_next, f"WITH {ST.MADE} SELECT finding_id, id, k % 7 AS priority, row_number() OVER (PARTITION BY finding_id ORDER BY k % 7, k) AS queue_position FROM made WHERE type = 'recommendation'"),
    "finding_coverage": (finding_coverage, _COVER),
    "critical_question": (critical_question, _CRITICAL),
    "site_reading": (site_reading, f"WITH {SITE} SELECT * FROM st"),
    "comparison_cells": (comparison_cells, f"WITH {_CELLS} SELECT site, dimension, label, value, established, proxy_for FROM cells"),
    "comparison_matrix": (comparison_matrix, f"WITH {_CELLS} SELECT row_order, label, " + ", ".join(f"max(value) FILTER (site = '{i}') AS \"{i}\"" for i in range(25)) + " FROM cells GROUP BY ALL"),
    "differentiating_rows": (differentiating_rows, f"WITH {_CELLS} SELECT dimension, label, bool_and(established) AS all_established, count(DISTINCT value) > 1 AS differentiating FROM cells GROUP BY ALL"),
    "site_coverage": (site_coverage, f"""WITH {_SIDES}, {_CELLS.replace('found AS', 'found_ AS')},
x AS (SELECT finding_id AS site, {", ".join(f"count(*) FILTER (type = '{t}') AS {t}" for t in V.STATEMENT_TYPES)} FROM st GROUP BY 1),
y AS (SELECT (split_part(finding_id, ':', 2)::BIGINT % 25)::VARCHAR AS site, count(*) AS conflicts FROM found GROUP BY 1),
z AS (SELECT (page_number % 25)::VARCHAR AS site, sum(n_chars % 15 + 1)::BIGINT AS unreadable_pages FROM pages_in WHERE page_number % 5 = 0 GROUP BY 1)
SELECT x.* REPLACE (x.fact + coalesce(e.n, 0) AS fact), coalesce(e.n, 0) AS evidence_passages, coalesce(conflicts, 0) AS conflicts, coalesce(unreadable_pages, 0) AS unreadable_pages,
  (SELECT count(*) FROM cells c WHERE c.site = x.site AND established) AS cells_established, (SELECT count(*) FROM cells c WHERE c.site = x.site) AS cells_total
FROM x LEFT JOIN y USING (site) LEFT JOIN z USING (site)
  LEFT JOIN (SELECT (page_number % 25)::VARCHAR AS site, count(*) AS n FROM pages_in GROUP BY 1) e USING (site)"""),
    "site_panels": (site_panels, f"""WITH {SITE}, f AS (SELECT finding_id, ordinal, text, limitation, {_PANEL} AS panel FROM st WHERE type = 'fact')
SELECT s.site::VARCHAR AS finding_id, p.panel, count(f.panel) AS facts, arg_min(f.limitation, f.ordinal) AS limitation, count(f.panel) > 0 AS available,
  coalesce(string_agg(f.text, ' | ' ORDER BY f.ordinal), '') AS texts
FROM sites s CROSS JOIN {_PANELS} LEFT JOIN f ON f.finding_id = s.site::VARCHAR AND f.panel = p.panel GROUP BY ALL"""),
    "map_features": (map_features, f"""WITH {_NATIONS} SELECT feature_id AS osm_id, coalesce(name, 'unnamed ' || replace(category, '_', ' ')) AS label,
  'https://www.openstreetmap.org/node/' || feature_id AS osm_url, CASE feature_id % 11 """ + " ".join(f"WHEN {i} THEN '{','.join(k for k, _ in pairs)}'" for i, (pairs, _) in enumerate(geo.TAGS)) + " END AS tag_keys, count(*) AS n FROM around GROUP BY ALL"),
}
