"""Places: customers are mapped features, suppliers are sites, orders are rain."""

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import places as P
from lacuna.operators import geography as G
from lacuna.operators.ranges import number_rows
from lacuna.sources.tables import read_table
from lacuna.workload.standins import finish

# tags of a feature by key modulo 11, and the category they lead to
TAGS = [
    ([("railway", "station")], "rail_station"), ([("station", "subway")], "rail_station"),
    ([("highway", "bus_stop")], "bus_stop"), ([("highway", "secondary")], "major_road"),
    ([("natural", "water")], "water"), ([("waterway", "canal")], "stream"),
    ([("amenity", "hospital")], "hospital"), ([("amenity", "school")], "school"),
    ([("leisure", "park")], "park"), ([("highway", "residential")], None),
    ([("waterway", "riverbank"), ("highway", "trunk")], "major_road"),
]


def tagged(spark, sf_dir):
    tags = F
    for i, (pairs, _) in enumerate(TAGS):
        entry = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
        tags = tags.when(F.col("c_custkey") % 11 == i, entry)
    return read_table(spark, sf_dir, "customer", spread=True).select(
        F.col("c_custkey").alias("feature_id"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"),
        (12.85 + (F.col("c_custkey") % 211) / 1000.0).alias("latitude"),
        (77.50 + (F.col("c_custkey") * 7 % 223) / 1000.0).alias("longitude"),
        tags.alias("tags"),
    ).withColumn("category", P.categorise(F.col("tags")))


def features(spark, sf_dir):
    return tagged(spark, sf_dir).where(F.col("category").isNotNull()).drop("tags")


def sites(spark, sf_dir):
    return read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site"),
        (12.85 + (F.col("s_suppkey") * 13 % 197) / 1000.0).alias("latitude"),
        (77.50 + (F.col("s_suppkey") * 17 % 199) / 1000.0).alias("longitude"),
    )


def haversine(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    d = P.haversine_m(12.85 + (F.col("c_custkey") % 211) / 1000.0, 77.50 + (F.col("c_custkey") * 7 % 223) / 1000.0,
                      10.0 + F.col("c_nationkey"), 70.0 + F.col("c_nationkey") / 2.0)
    return c.select("c_custkey", F.round(d, 1).alias("distance_m"))


def categorise(spark, sf_dir):
    return tagged(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def category_ranking(spark, sf_dir):
    return finish(G.category_ranking(tagged(spark, sf_dir)))


def _around(spark, sf_dir):
    return G.features_around(sites(spark, sf_dir), features(spark, sf_dir))


def radius_search(spark, sf_dir):
    return _around(spark, sf_dir).select("site", "feature_id", "category", "distance_m")


def nearest_per_category(spark, sf_dir):
    return G.nearest_features(sites(spark, sf_dir), features(spark, sf_dir))


def category_counts(spark, sf_dir):
    return G.counts_around(sites(spark, sf_dir), features(spark, sf_dir))


def bbox_extent(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(
        "c_nationkey", (12.85 + (F.col("c_custkey") % 211) / 1000.0).alias("lat"), (77.50 + (F.col("c_custkey") * 7 % 223) / 1000.0).alias("lon"))
    box = c.groupBy("c_nationkey").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    return finish(box.select("c_nationkey", P.extent_km(F.col("s"), F.col("n"), F.col("w"), F.col("e")).alias("extent_km")))


def _candidates(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("query"), "s_suppkey", (F.col("s_acctbal") / 10000).alias("importance"),
        (12.85 + (F.col("s_suppkey") * 13 % 197) / 1000.0).alias("latitude"),
        (77.50 + (F.col("s_suppkey") * 17 % 199) / 1000.0).alias("longitude"),
        F.element_at(F.array(F.lit("suburb"), F.lit("station"), F.lit("city")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("place_type"),
    )
    placed = number_rows(s, "query", "s_suppkey", "rank").withColumn("position", F.col("rank") - 1)
    return (placed.withColumn("south", F.col("latitude") - 0.01).withColumn("north", F.col("latitude") + 0.02)
            .withColumn("west", F.col("longitude") - 0.03).withColumn("east", F.col("longitude") + 0.01))


def ambiguity(spark, sf_dir):
    return finish(G.geocode_choice(_candidates(spark, sf_dir)))


def sample_points(spark, sf_dir):
    return finish(G.sample_points(sites(spark, sf_dir)))


def _samples(spark, sf_dir):
    p = G.sample_points(sites(spark, sf_dir))
    elevation = F.when((F.col("site") + F.col("position")) % 13 != 0, 900.0 + (F.col("site") * 31 + F.col("position") * 17) % 23)
    return p.withColumn("elevation_m", elevation)


def relief_position(spark, sf_dir):
    return G.terrain(_samples(spark, sf_dir))


def daily(spark, sf_dir):
    """Rain per station and day: tenths of a millimetre from order prices."""
    tenths = F.floor(F.round(F.col("o_totalprice") * 100) / 500000)
    return (
        read_table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("day"))
        .agg((F.sum(tenths) / 10.0).alias("mm"))
    )


def yearly_totals(spark, sf_dir):
    return G.period_totals(daily(spark, sf_dir), "year")


def monthly_totals(spark, sf_dir):
    return G.period_totals(daily(spark, sf_dir), "month")


def _climate(spark, sf_dir):
    return G.climate_summary(daily(spark, sf_dir))


def max_day(spark, sf_dir):
    return _climate(spark, sf_dir).select("site", "max_daily_mm", "max_daily_date")


def threshold_days(spark, sf_dir):
    return _climate(spark, sf_dir).select("site", "days_over_50mm", "days_over_100mm")


def wettest_month(spark, sf_dir):
    return _climate(spark, sf_dir).select("site", "wettest_month", "wettest_month_mm")


def mean_annual(spark, sf_dir):
    return _climate(spark, sf_dir).select("site", "years_covered", "mean_annual_mm")


def grid_drift(spark, sf_dir):
    s = sites(spark, sf_dir)
    return s.select("site", G.grid_drift_km(F.col("latitude"), F.col("longitude"),
                                            F.floor(F.col("latitude") * 4) / 4, F.floor(F.col("longitude") * 4) / 4).alias("drift_km"))


def period_ends(spark, sf_dir):
    end = F.date_format(G.default_end_date(F.to_date("o_orderdate")), "yyyy-MM-dd")
    return read_table(spark, sf_dir, "orders").groupBy(end.alias("end_date")).agg(F.count(F.lit(1)).alias("n"))


def hav_sql(a, b, c, d):
    return (f"2 * 6371000.0 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
            f"pow(sin(radians(({d}) - ({b})) / 2), 2)))")


_CLAT, _CLON = "(12.85::DOUBLE + (c_custkey % 211) / 1000.0)", "(77.50::DOUBLE + (c_custkey * 7 % 223) / 1000.0)"
_SLAT, _SLON = "(12.85::DOUBLE + (s_suppkey * 13 % 197) / 1000.0)", "(77.50::DOUBLE + (s_suppkey * 17 % 199) / 1000.0)"
_CAT = "CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(TAGS) if c) + " END"
_RADIUS = "CASE category " + " ".join(f"WHEN '{c}' THEN {r}" for c, r in V.QUERY_PLAN) + " END"
AROUND = f"""features AS (
  SELECT c_custkey AS feature_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, {_CLAT} AS lat, {_CLON} AS lon, {_CAT} AS category FROM customer
), sites AS (SELECT s_suppkey AS site, {_SLAT} AS slat, {_SLON} AS slon FROM supplier
), pairs AS (SELECT site, feature_id, name, category, {hav_sql('slat', 'slon', 'lat', 'lon')} AS d FROM sites, features WHERE category IS NOT NULL
), around AS (SELECT site, feature_id, name, category, round(d, 1) AS distance_m FROM pairs WHERE d <= {_RADIUS}
), nearest AS (SELECT site, category, feature_id, coalesce(name, 'unnamed ' || replace(category, '_', ' ')) AS label, distance_m FROM around
  QUALIFY row_number() OVER (PARTITION BY site, category ORDER BY distance_m, feature_id) = 1)"""
_CATS = "(VALUES " + ", ".join(f"('{c}')" for c in V.CATEGORIES) + ") AS k(category)"
COUNTS = f"""counts AS (SELECT s.site, k.category, count(a.feature_id) AS n FROM sites s CROSS JOIN {_CATS}
  LEFT JOIN around a ON a.site = s.site AND a.category = k.category GROUP BY ALL)"""

_BEARINGS = "(VALUES (0, 'site', 0.0, 0.0), " + ", ".join(f"({i}, '{b}', {n}, {e})" for i, (b, n, e) in enumerate(V.BEARINGS, 1)) + ") AS b(position, bearing, north, east)"
_POINTS = f"""points AS (
  SELECT s_suppkey AS site, position::BIGINT AS position, bearing,
    CASE WHEN position = 0 THEN {_SLAT} ELSE round({_SLAT} + north::DOUBLE * (400 / 111000.0::DOUBLE), 6) END AS latitude,
    CASE WHEN position = 0 THEN {_SLON} ELSE round({_SLON} + east::DOUBLE * (400.0::DOUBLE / (109000 * greatest(0.1, abs(cos(radians({_SLAT})))))), 6) END AS longitude
  FROM supplier CROSS JOIN {_BEARINGS})"""
_TERRAIN = f"""WITH {_POINTS}, e AS (
  SELECT site, bearing, CASE WHEN (site + position) % 13 <> 0 THEN 900.0::DOUBLE + (site * 31 + position * 17) % 23 END AS m FROM points
), t AS (SELECT site, max(m) FILTER (bearing = 'site') AS site_elevation_m, round(max(m) - min(m), 1) AS local_relief_m,
    round(avg(m) FILTER (bearing <> 'site'), 1) AS mean_neighbourhood_m FROM e WHERE m IS NOT NULL GROUP BY site HAVING site_elevation_m IS NOT NULL
), r AS (SELECT *, round(site_elevation_m - mean_neighbourhood_m, 1) AS relative_position_m FROM t)
SELECT *, CASE WHEN relative_position_m <= -2 THEN 'The site sits ' || abs(relative_position_m) || ' m below the mean of sampled points within 400 m.'
  WHEN relative_position_m >= 2 THEN 'The site sits ' || relative_position_m || ' m above the mean of sampled points within 400 m.'
  ELSE 'The site is within 2 m of the mean of sampled points within 400 m ' || chr(8212) || ' effectively level at this resolution.' END AS position_description FROM r"""

DAILY = """daily AS (
  SELECT o_orderpriority AS site, o_orderdate::DATE AS day, sum(floor(round(o_totalprice * 100) / 500000)) / 10.0::DOUBLE AS mm FROM orders GROUP BY ALL)"""
_YEARS = f"{DAILY}, years AS (SELECT site, strftime(day, '%Y') AS year, sum(mm::DECIMAL(18,1))::DOUBLE AS total_mm FROM daily GROUP BY ALL)"
_MONTHS = f"{DAILY}, months AS (SELECT site, strftime(day, '%Y-%m') AS month, sum(mm::DECIMAL(18,1))::DOUBLE AS total_mm FROM daily GROUP BY ALL)"
_CAND = f"""cand AS (SELECT s_nationkey::BIGINT AS query, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position,
  s_acctbal / 10000 AS imp, {_SLAT} AS lat, {_SLON} AS lon, s_suppkey % 3 AS p FROM supplier)"""

QUERIES = {
    "haversine": (haversine, f"SELECT c_custkey, round({hav_sql(_CLAT, _CLON, '(10.0::DOUBLE + c_nationkey)', '(70.0::DOUBLE + c_nationkey / 2.0)')}, 1) AS distance_m FROM customer"),
    "categorise": (categorise, f"SELECT {_CAT} AS category, count(*) AS n FROM customer GROUP BY 1"),
    "category_ranking": (category_ranking, f"SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS position FROM (SELECT {_CAT} AS category, count(*) AS n FROM customer GROUP BY 1) WHERE category IS NOT NULL"),
    "radius_search": (radius_search, f"WITH {AROUND} SELECT site, feature_id, category, distance_m FROM around"),
    "nearest_per_category": (nearest_per_category, f"WITH {AROUND} SELECT site, category, feature_id, label, distance_m FROM nearest"),
    "category_counts": (category_counts, f"WITH {AROUND}, {COUNTS} SELECT * FROM counts"),
    "bbox_extent": (bbox_extent, f"""SELECT c_nationkey::BIGINT AS c_nationkey, round(sqrt(pow((max({_CLAT}) - min({_CLAT})) * 111, 2) + pow((max({_CLON}) - min({_CLON})) * 109, 2)), 2) AS extent_km FROM customer GROUP BY 1"""),
    "ambiguity": (ambiguity, f"""WITH {_CAND} SELECT a.query, (SELECT count(*) FROM cand c WHERE c.query = a.query) AS candidates, a.lat AS latitude, a.lon AS longitude,
  a.p <> 1 AS is_area_centroid, round(sqrt(pow(((a.lat + 0.02) - (a.lat - 0.01)) * 111, 2) + pow(((a.lon + 0.01) - (a.lon - 0.03)) * 109, 2)), 2) AS extent_km,
  coalesce(sqrt(pow((a.lat - b.lat) * 111, 2) + pow((a.lon - b.lon) * 109, 2)) > 2.0 OR abs(a.imp - b.imp) < 0.05, false) AS is_ambiguous
FROM cand a LEFT JOIN cand b ON b.query = a.query AND b.position = 1 WHERE a.position = 0"""),
    "sample_points": (sample_points, f"WITH {_POINTS} SELECT * FROM points"),
    "relief_position": (relief_position, _TERRAIN),
    "yearly_totals": (yearly_totals, f"WITH {_YEARS} SELECT * FROM years"),
    "monthly_totals": (monthly_totals, f"WITH {_MONTHS} SELECT * FROM months"),
    "max_day": (max_day, f"WITH {DAILY} SELECT site, round(mm, 1) AS max_daily_mm, strftime(day, '%Y-%m-%d') AS max_daily_date FROM daily QUALIFY row_number() OVER (PARTITION BY site ORDER BY mm DESC, day) = 1"),
    "threshold_days": (threshold_days, f"WITH {DAILY} SELECT site, count(*) FILTER (mm >= 50) AS days_over_50mm, count(*) FILTER (mm >= 100) AS days_over_100mm FROM daily GROUP BY site"),
    "wettest_month": (wettest_month, f"WITH {_MONTHS} SELECT site, month AS wettest_month, total_mm AS wettest_month_mm FROM months QUALIFY row_number() OVER (PARTITION BY site ORDER BY total_mm DESC, month) = 1"),
    "mean_annual": (mean_annual, f"WITH {_YEARS} SELECT site, count(*) AS years_covered, round(avg(total_mm), 1) AS mean_annual_mm FROM years GROUP BY site"),
    "grid_drift": (grid_drift, f"SELECT s_suppkey AS site, round({hav_sql(_SLAT, _SLON, f'(floor({_SLAT} * 4) / 4)', f'(floor({_SLON} * 4) / 4)')} / 1000, 2) AS drift_km FROM supplier"),
    "period_ends": (period_ends, "SELECT strftime(make_date(year(o_orderdate) - 1, 12, 31), '%Y-%m-%d') AS end_date, count(*) AS n FROM orders GROUP BY 1"),
}
