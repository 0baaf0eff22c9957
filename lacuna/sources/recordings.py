"""Recorded provider responses as tables, and what each provider's payload holds.

A recording is JSON: provider, endpoint, query, captured_at, key, payload.  The
payload stays text until its provider's reader parses it, so a payload that no
longer parses is one null row and never a failed job.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import values as V
from lacuna.functions import places as P
from lacuna.session import materialise

ENVELOPE = (
    "provider string, endpoint string, query map<string,string>, captured_at string, key string, payload string"
)
NOMINATIM = (
    "array<struct<place_id:bigint,osm_type:string,osm_id:bigint,lat:string,lon:string,type:string,"
    "addresstype:string,importance:double,display_name:string,address:map<string,string>,boundingbox:array<string>>>"
)
OPENTOPODATA = "struct<results:array<struct<elevation:double,location:struct<lat:double,lng:double>>>,status:string>"
OVERPASS = (
    "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,"
    "center:struct<lat:double,lon:double>,tags:map<string,string>>>,osm3s:struct<timestamp_osm_base:string>>"
)
OPEN_METEO = (
    "struct<latitude:double,longitude:double,elevation:double,"
    "daily:struct<time:array<string>,precipitation_sum:array<double>>>"
)
PAYLOADS = {
    "nominatim": NOMINATIM,
    "opentopodata-srtm30m": OPENTOPODATA,
    "overpass": OVERPASS,
    "open-meteo-era5": OPEN_METEO,
}

def _raw_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw, F.col("key").isNotNull() & F.col("provider").isNotNull()


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """All readable recordings under a folder; `broken_recordings` names the others."""
    raw, sound = _raw_recordings(spark, path)
    return raw.where(sound).withColumn("captured_at", F.try_to_timestamp("captured_at"))


def broken_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Files under the folder that hold no recording: (file)."""
    raw, sound = _raw_recordings(spark, path)
    return raw.withColumn("file", F.col("_metadata.file_path")).where(~sound).select("file").distinct()


def write_recordings(recordings: DataFrame, path: str) -> None:
    """Append recordings, one folder per provider; payloads are kept verbatim."""
    recordings.withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).select(
        "provider", "endpoint", "query", "captured_at", "key", "payload"
    ).write.mode("append").json(path)


class RecordingStore:
    """Recordings by key: a request opens the buckets of its key and no others.

    Parquet, a folder per bucket of hashed keys, sorted by key in each file, so that a
    look-up prunes folders and then row groups.  Uploads are appended; `compact` leaves
    the newest recording of each key.
    """

    COLUMNS = ["provider", "endpoint", "query", "captured_at", "key", "payload"]

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, recordings: DataFrame, mode: str) -> None:
        dealt = recordings.select(*self.COLUMNS, self._bucket()).repartition("bucket").sortWithinPartitions("bucket", "key")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def append(self, recordings: DataFrame) -> None:
        """Add recordings that have a key; one of the same key may be there already."""
        self._write(recordings.where(F.col("key").isNotNull()), "append")

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def for_requests(self, requests: DataFrame) -> DataFrame:
        """The newest recording of each requested key; the buckets of all requests are few numbers."""
        asked = requests.select("key", self._bucket()).where(F.col("key").isNotNull()).distinct()
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
        found = self.all().where(F.col("bucket").isin(buckets)).join(asked, ["bucket", "key"], "left_semi")
        return self._newest(found)

    def _newest(self, recordings: DataFrame) -> DataFrame:
        # Of equal times the greater payload, so that runs agree.
        newest = F.max_by(F.struct(*self.COLUMNS), F.struct("captured_at", "payload", "endpoint"))
        return recordings.groupBy("key").agg(newest.alias("r")).select("r.*")

    def compact(self) -> None:
        """Write each bucket anew with the newest recording of each key; buckets are replaced one by one."""
        self._write(materialise(self._newest(self.all())), "overwrite")


def cache_key(provider: Column, query_json: Column) -> Column:
    """Key of a request; `query_json` has sorted keys and one space after ':' and ','."""
    blob = F.concat(F.lit('{"p": "'), provider, F.lit('", "q": '), query_json, F.lit("}"))
    return F.concat(provider, F.lit("-"), F.left(F.sha2(blob, 256), F.lit(24)))


def _parsed(recordings: DataFrame, provider: str) -> DataFrame:
    return recordings.where(F.col("provider") == provider).withColumn(
        "p", F.from_json("payload", PAYLOADS[provider])
    )


def geocode_candidates(recordings: DataFrame) -> DataFrame:
    """Candidates in the service's order; an empty list gives no row."""
    rows = _parsed(recordings, "nominatim").select(
        F.col("query")["query"].alias("query"), "key", "captured_at", F.posexplode("p").alias("position", "c")
    )
    box = F.transform("c.boundingbox", lambda v: v.try_cast("double"))
    whole = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull())

    def edge(i: int) -> Column:
        return F.when(whole, F.try_element_at(box, F.lit(i)))

    return rows.select(
        "query", "key", "captured_at", "position",
        F.col("c.lat").try_cast("double").alias("latitude"),
        F.col("c.lon").try_cast("double").alias("longitude"),
        F.coalesce("c.display_name", F.lit("")).alias("display_name"),
        F.coalesce(F.nullif("c.addresstype", F.lit("")), F.nullif("c.type", F.lit("")), F.lit("unknown")).alias("place_type"),
        F.coalesce("c.importance", F.lit(0.0)).alias("importance"),
        edge(1).alias("south"), edge(2).alias("north"), edge(3).alias("west"), edge(4).alias("east"),
        "c.osm_type", "c.osm_id", "c.address",
    )


def elevation_samples(recordings: DataFrame) -> DataFrame:
    """Positional samples named by bearing; a null site elevation gives no rows at all."""
    good = _parsed(recordings, "opentopodata-srtm30m").where(
        (F.col("p.status") == "OK") & F.try_element_at("p.results", F.lit(1))["elevation"].isNotNull()
    )
    names = F.array(F.lit("site"), *[F.lit(b) for b, _, _ in V.BEARINGS])
    return (
        good.select("key", F.posexplode("p.results").alias("position", "r"))
        .withColumn("bearing", F.try_element_at(names, F.col("position") + 1))
        .where(F.col("bearing").isNotNull() & F.col("r.elevation").isNotNull())
        .select(
            F.col("key").alias("site"), "position", "bearing",
            F.col("r.location.lat").alias("latitude"), F.col("r.location.lng").alias("longitude"),
            F.col("r.elevation").alias("elevation_m"),
        )
    )


def overpass_features(recordings: DataFrame) -> DataFrame:
    """Categorised features with their distance from the requested point."""
    site_lat, site_lon = F.col("query")["latitude"].cast("double"), F.col("query")["longitude"].cast("double")
    rows = _parsed(recordings, "overpass").select(
        "key", site_lat.alias("site_lat"), site_lon.alias("site_lon"), F.explode("p.elements").alias("e")
    )
    placed = rows.select(
        F.col("key").alias("site"), "site_lat", "site_lon",
        F.coalesce("e.type", F.lit("node")).alias("osm_type"),
        F.coalesce("e.id", F.lit(0)).alias("osm_id"),
        F.coalesce("e.lat", "e.center.lat").alias("latitude"),
        F.coalesce("e.lon", "e.center.lon").alias("longitude"),
        F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"),
    )
    return (
        placed.withColumn("category", P.categorise(F.col("tags")))
        .where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("category").isNotNull())
        .withColumn("name", F.try_element_at("tags", F.lit("name")))
        .withColumn(
            "distance_m",
            F.round(P.haversine_m(F.col("site_lat"), F.col("site_lon"), F.col("latitude"), F.col("longitude")), 1),
        )
        .withColumn("feature_id", F.col("osm_id"))
        .drop("site_lat", "site_lon")
    )


def climate_days(recordings: DataFrame) -> DataFrame:
    """Days of rain with the distance between site and grid cell."""
    lat, lon = F.col("query")["latitude"].cast("double"), F.col("query")["longitude"].cast("double")
    drift = F.round(
        P.haversine_m(lat, lon, F.coalesce("p.latitude", lat), F.coalesce("p.longitude", lon)) / 1000, 2
    )
    days = F.arrays_zip(F.col("p.daily.time").alias("day"), F.col("p.daily.precipitation_sum").alias("mm"))
    return (
        _parsed(recordings, "open-meteo-era5")
        .withColumn("grid_drift_km", drift)
        .select(F.col("key").alias("site"), "grid_drift_km", F.explode(days).alias("d"))
        .select("site", "grid_drift_km", F.to_date("d.day").alias("day"), F.col("d.mm").alias("mm"))
    )


def usable(recordings: DataFrame) -> Column:
    """Whether the payload parses into its provider's shape."""
    out = F
    for provider, shape in PAYLOADS.items():
        out = out.when(F.col("provider") == provider, F.from_json("payload", shape).isNotNull())
    return out.otherwise(F.lit(False))


def verify_recordings(recordings: DataFrame) -> DataFrame:
    """(key, problem) for recordings no reader knows or that no longer parse."""
    known = F.col("provider").isin(list(PAYLOADS))
    problem = F.when(~known, F.concat(F.lit("no parser registered for "), "provider")).when(
        ~usable(recordings), "does not parse"
    )
    return recordings.select("key", problem.alias("problem")).where(F.col("problem").isNotNull())


def choose_responses(requests: DataFrame, recordings: DataFrame, live: DataFrame, now: Column | None = None) -> DataFrame:
    """One result per request: fresh recording, else live answer, else stale recording, else failure.

    requests(key, provider); live(key, attempt, endpoint, ok, payload, error, retrieved_at)
    holds whatever attempts were made, mirrors in order.  Never empty for a request.
    """
    at = F.current_timestamp() if now is None else now
    age = (F.unix_micros(at) - F.unix_micros("captured_at")) / 86_400e6
    kept = recordings.where(usable(recordings)).select(
        "key",
        F.when(age > V.STALE_AFTER_DAYS, 2).otherwise(0).alias("choice"),
        F.lit(0).alias("attempt"), F.lit("(recorded)").alias("endpoint"), "payload",
        F.col("captured_at").alias("retrieved_at"),
    )
    fetched = live.where("ok").select("key", F.lit(1).alias("choice"), "attempt", "endpoint", "payload", "retrieved_at")
    best = kept.unionByName(fetched).groupBy("key").agg(
        F.min(F.struct("choice", "attempt", "endpoint", "payload", "retrieved_at")).alias("b")
    )
    tried = live.groupBy("key").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("attempt", F.concat_ws(" -> ", "endpoint", F.when(F.col("ok"), "OK").otherwise(F.col("error"))).alias("t")))),
                lambda x: x["t"],
            ),
            "; ",
        ).alias("attempts")
    )
    stale = F.col("b.choice") == 2
    return (
        requests.join(best, "key", "left")
        .join(tried, "key", "left")
        .select(
            "key", "provider", F.col("b").isNotNull().alias("ok"),
            F.when(stale, "(recorded — live fetch failed)").otherwise(F.col("b.endpoint")).alias("endpoint"),
            "b.payload", "b.retrieved_at", F.coalesce(F.col("b.choice") != 1, F.lit(False)).alias("cached"),
            F.when(F.col("b").isNull(), "all endpoints failed").alias("error"), "attempts",
        )
    )


def unavailable_message() -> Column:
    """What is told when a provider gave nothing, with what was tried."""
    tried = F.coalesce(F.concat(F.lit(" Attempted: "), F.col("attempts"), F.lit(".")), F.lit(""))
    return F.concat(
        F.col("provider"), F.lit(" data is unavailable for this location. Reason: "),
        F.coalesce("error", F.lit("unknown")), F.lit("."), tried,
    )
