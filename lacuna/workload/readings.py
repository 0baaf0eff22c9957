"""Statements from climate and terrain, what is absent, and how old recordings are."""

import datetime as dt

from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.operators import assembly as A
from lacuna.operators import geography as G
from lacuna.operators import reports as O
from lacuna.sources.tables import read_table
from lacuna.workload import geography as geo
from lacuna.workload import reports as R
from lacuna.workload.standins import finish

def climate_reading(spark, sf_dir):
    """What each station's rain says: mean, peak, and how far the grid cell is."""
    days = geo.daily(spark, sf_dir)
    span = days.groupBy("site").agg(F.min("day").cast("string").alias("start_date"), F.max("day").cast("string").alias("end_date"))
    summed = G.climate_summary(days).join(span, "site").withColumn("finding_id", F.col("site"))
    drift = F.round(F.length("site") / 4.0, 2)
    made = A.climate_statements(R.provided(summed.withColumn("grid_drift_km", drift), R.CLIMATE_SOURCE))
    return finish(made.select("finding_id", "ordinal", "type", "text", "proxy_for", "limitation"))


_CLIMATE = f"""WITH {geo.DAILY}, y AS (SELECT site, count(*) AS years, round(avg(t), 1) AS mean FROM (
    SELECT site, strftime(day, '%Y') AS year, sum(mm::DECIMAL(18,1))::DOUBLE AS t FROM daily GROUP BY ALL) GROUP BY site),
p AS (SELECT site, round(mm, 1) AS peak, day FROM daily QUALIFY row_number() OVER (PARTITION BY site ORDER BY mm DESC, day) = 1),
s AS (SELECT site, min(day) AS a, max(day) AS z, count(*) FILTER (mm >= 50) AS n FROM daily GROUP BY site)
SELECT site AS finding_id, 30::BIGINT AS ordinal, 'fact' AS type, 'Mean annual precipitation ' || mean || ' mm across ' || years || ' years (' || a || ' to ' || z || ').' AS text,
  'rainfall exposure at the site' AS proxy_for, '{R.CLIMATE_SOURCE["limitation"]}' AS limitation FROM y JOIN s USING (site)
UNION ALL SELECT site, 31, 'fact', 'Peak recorded daily rainfall ' || peak || ' mm on ' || day || '; ' || n || ' day(s) above 50 mm in the period.',
  'intensity of extreme rainfall events', '{R.CLIMATE_SOURCE["limitation"]}' FROM p JOIN s USING (site)
UNION ALL SELECT site, 230, 'assumption', 'Climate values describe an ERA5 grid cell ' || round(length(site) / 4.0::DOUBLE, 2) || ' km from the site, not the site itself.', NULL, NULL FROM s"""


def terrain_reading(spark, sf_dir):
    """Elevation of each site, and what its neighbourhood makes of it."""
    t = geo.relief_position(spark, sf_dir).withColumn("finding_id", F.col("site").cast("string"))
    made = A.terrain_statements(R.provided(t, R.CLIMATE_SOURCE))
    return finish(made.select("finding_id", "ordinal", "type", "text", "proxy_for", F.size("derived_from").alias("n_parents"), "confidence"))


_TERRAIN = f"""WITH t AS ({geo._TERRAIN})
SELECT site::VARCHAR AS finding_id, 40::BIGINT AS ordinal, 'fact' AS type, 'Site elevation ' || site_elevation_m || ' m; local relief ' || local_relief_m ||
  ' m across sampled points within {V.SAMPLE_RADIUS_M} m.' AS text, 'position within the local catchment' AS proxy_for, NULL::BIGINT AS n_parents, NULL::VARCHAR AS confidence FROM t
UNION ALL SELECT site::VARCHAR, 100, 'inference', position_description, NULL, 1, 'low' FROM t"""

_ABSENT = ["Classes of land use: no source.", "Outlines of plots: no source."]


def absent_sources(spark, sf_dir):
    """What every nation's finding lacks: errors of its day, then what nobody publishes."""
    findings = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("finding_id"))
    failures = read_table(spark, sf_dir, "events").where("event_type = 'error'").select(
        (F.col("user_id") % 25).cast("string").alias("finding_id"), F.col("event_id").alias("ordinal"),
        F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("text"))
    return finish(A.unavailable_sources(findings, failures, _ABSENT))


_ABSENCES = "SELECT (user_id % 25)::VARCHAR AS finding_id, event_id AS ordinal, 'error ' || event_id AS text FROM events WHERE event_type = 'error'" + "".join(
    f" UNION ALL SELECT n_nationkey::VARCHAR, {100 + i}, '{t}' FROM nation" for i, t in enumerate(_ABSENT))


def recording_ages(spark, sf_dir):
    """Events as recordings: how many of each kind, and how old on a fixed day."""
    recorded = read_table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("captured_at"))
    return O.recordings_summary(recorded, ["event_type"], F.lit(dt.datetime(2025, 1, 1)))


_AGE = "(epoch_us(TIMESTAMP '2025-01-01') - epoch_us(ts)) / 86400000000.0::DOUBLE"
_AGES = f"""SELECT event_type, count(*) AS recordings, round(max({_AGE}), 1) AS oldest_days, round(min({_AGE}), 1) AS newest_days,
  bool_or({_AGE} > {V.STALE_AFTER_DAYS}) AS any_stale FROM events GROUP BY event_type"""


def failed_agents(spark, sf_dir):
    ran = read_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("finding_id"), F.col("event_type").alias("agent"),
        (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").alias("error"))
    return O.failed_agents(ran).groupBy("finding_id", "agent", "error").agg(F.count(F.lit(1)).alias("n"))


_FAILED = "SELECT user_id::VARCHAR AS finding_id, event_type AS agent, json_extract_string(props, '$.k') AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL"


def undifferentiating_rows(spark, sf_dir):
    """Dimensions that every site has and none differs in, with the value they share."""
    cells = R._cells(spark, sf_dir)
    same = O.undifferentiating(O.comparison_rows(cells)).select("dimension", "label")
    return same.join(cells.select("dimension", "value").distinct(), "dimension")


_SAME = f"""WITH {R._CELLS} SELECT dimension, label, min(value) AS value FROM cells GROUP BY ALL
HAVING bool_and(established) AND NOT coalesce(min(value) <> max(value), false)"""


def undifferentiating_dimensions(spark, sf_dir):
    """Dimensions that every site has and none differs in, over all sites."""
    return O.undifferentiating(O.comparison_rows(R._cells(spark, sf_dir))).select("dimension", "label")


_SAME_EVERYWHERE = f"""WITH {R._CELLS} SELECT dimension, label FROM cells GROUP BY ALL
HAVING bool_and(established) AND NOT coalesce(min(value) <> max(value), false)"""

QUERIES = {
    "climate_reading": (climate_reading, _CLIMATE),
    "terrain_reading": (terrain_reading, _TERRAIN),
    "absent_sources": (absent_sources, _ABSENCES),
    "recording_ages": (recording_ages, _AGES),
    "failed_agents": (failed_agents, _FAILED),
    "undifferentiating_rows": (undifferentiating_rows, _SAME),
    "undifferentiating_dimensions": (undifferentiating_dimensions, _SAME_EVERYWHERE),
}
