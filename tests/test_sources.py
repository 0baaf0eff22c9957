"""Recordings, uploads, reports and the upload stream."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from lacuna.operators import geography as G
from lacuna.sources import recordings as R
from lacuna.sources import reports, uploads
from lacuna.streaming.uploads import arriving_pages, ingest_stream


def record(folder, key, provider, query, payload, day="2026-09-20"):
    body = {"provider": provider, "endpoint": "https://example.org", "query": query,
            "captured_at": f"{day}T10:00:00+00:00", "key": key, "payload": payload}
    (folder / f"{key}.json").write_text(json.dumps(body, indent=2))


def recordings(spark, tmp_path):
    place = {"lat": "12.90", "lon": "77.60", "type": "residential", "addresstype": "suburb", "importance": 0.31,
             "display_name": "Lakeside, City", "boundingbox": ["12.89", "12.92", "77.58", "77.61"], "address": {"city": "City"}}
    far = dict(place, lat="13.4", addresstype="", type="station", importance=0.30, boundingbox=["x"])
    record(tmp_path, "n1", "nominatim", {"query": "Lakeside", "limit": 5}, [place, far])
    record(tmp_path, "n2", "nominatim", {"query": "Nowhere", "limit": 5}, [])
    at = {"latitude": 12.9, "longitude": 77.6}
    record(tmp_path, "e1", "opentopodata-srtm30m", at, {"status": "OK", "results": [
        {"elevation": e, "location": {"lat": 12.9, "lng": 77.6}} for e in (900.0, 903.0, None, 905.0, 904.0, 903.0, 906.0, 902.0, 905.0)]})
    record(tmp_path, "e2", "opentopodata-srtm30m", at, {"status": "OK", "results": [{"elevation": None, "location": {"lat": 1, "lng": 1}}]})
    record(tmp_path, "o1", "overpass", at, {"elements": [
        {"type": "way", "id": 5, "center": {"lat": 12.901, "lon": 77.6}, "tags": {"natural": "water", "name": "Big Lake"}},
        {"type": "node", "id": 6, "lat": 12.9, "lon": 77.6005, "tags": {"highway": "bus_stop"}},
        {"type": "node", "id": 7, "lat": 12.9, "lon": 77.6, "tags": {"shop": "books"}},
        {"type": "way", "id": 8, "tags": {"leisure": "park"}}], "osm3s": {}})
    record(tmp_path, "c1", "open-meteo-era5", at, {"latitude": 12.94, "longitude": 77.6, "daily": {
        "time": ["2020-01-01", "2020-01-02", "2020-02-01", "2021-01-01"], "precipitation_sum": [50.0, None, 120.5, 120.5]}})
    record(tmp_path, "x1", "mystery", {}, {})
    (tmp_path / "broken.json").write_text("{not json")
    return R.read_recordings(spark, str(tmp_path))


def test_payload_readers(spark, tmp_path):
    rec = recordings(spark, tmp_path)
    assert rec.count() == 7
    best = {r["query"]: r for r in G.geocode_choice(R.geocode_candidates(rec)).collect()}
    assert set(best) == {"Lakeside"}
    assert best["Lakeside"].is_area_centroid and best["Lakeside"].is_ambiguous and best["Lakeside"].extent_km == round(((0.03 * 111) ** 2 + (0.03 * 109) ** 2) ** 0.5, 2)
    terrain = G.terrain(R.elevation_samples(rec)).collect()
    assert [(t.site, t.local_relief_m, t.mean_neighbourhood_m, t.relative_position_m) for t in terrain] == [("e1", 6.0, 904.0, -4.0)]
    assert terrain[0].position_description == "The site sits 4.0 m below the mean of sampled points within 400 m."
    features = {r.osm_id: r for r in R.overpass_features(rec).collect()}
    assert {k: v.category for k, v in features.items()} == {5: "water", 6: "bus_stop"} and features[5].distance_m == 111.2
    rain = G.climate_summary(R.climate_days(rec)).first()
    assert (rain.years_covered, rain.mean_annual_mm, rain.wettest_month, rain.max_daily_date) == (2, 145.5, "2020-02", "2020-02-01")
    assert (rain.days_over_50mm, rain.days_over_100mm) == (3, 2)
    assert [r.file.rsplit("/", 1)[1] for r in R.broken_recordings(spark, str(tmp_path)).collect()] == ["broken.json"]
    problems = {r.key: r.problem for r in R.verify_recordings(rec).collect()}
    assert problems == {"x1": "no parser registered for mystery"}


def test_recordings_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rec = recordings(spark, tmp_path / "in")
    R.write_recordings(rec, str(tmp_path / "out"))
    again = spark.read.schema(R.ENVELOPE).json(str(tmp_path / "out"))
    assert again.count() == 7 and {r.key for r in again.collect()} == {r.key for r in rec.collect()}


def test_choice_of_response(spark, tmp_path):
    old, new = dt.datetime(2026, 1, 1), dt.datetime(2026, 9, 1)
    rec = spark.createDataFrame(
        [("a", "nominatim", "[]", new), ("b", "nominatim", "[]", old), ("c", "nominatim", "[]", old)],
        "key string, provider string, payload string, captured_at timestamp")
    live = spark.createDataFrame(
        [("b", 1, "m1", False, None, "timeout", None), ("b", 2, "m2", True, "[1]", None, new),
         ("c", 1, "m1", False, None, "504", None), ("d", 1, "m1", False, None, "504", None)],
        "key string, attempt int, endpoint string, ok boolean, payload string, error string, retrieved_at timestamp")
    asked = spark.createDataFrame([(k, "nominatim") for k in "abcd"], "key string, provider string")
    now = F.lit(dt.datetime(2026, 9, 10))
    got = {r.key: r for r in R.choose_responses(asked, rec, live, now).withColumn("m", R.unavailable_message()).collect()}
    assert got["a"].cached and got["a"].endpoint == "(recorded)"
    assert not got["b"].cached and got["b"].endpoint == "m2" and got["b"].attempts == "m1 -> timeout; m2 -> OK"
    assert got["c"].endpoint.startswith("(recorded —")
    assert not got["d"].ok and "Attempted: m1 -> 504." in got["d"].m


def test_cache_key_is_stable(spark):
    row = spark.range(1).select(R.cache_key(F.lit("nominatim"), F.lit('{"limit": 5, "query": "x"}')).alias("k")).first()
    assert row.k.startswith("nominatim-") and len(row.k) == len("nominatim-") + 24


def test_upload_guards(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"{i}.pdf").write_bytes(b"%PDF-1.4 " + bytes([i]) * (i + 1))
    (tmp_path / "notes.pdf").write_bytes(b"hello")
    files = uploads.read_files(spark, str(tmp_path))
    accepted, refused = uploads.guard(files)
    assert accepted.count() == 9 and [r.problem for r in refused.collect()] == ["That file is not a PDF."]
    accepted, refused = uploads.guard(files, max_bytes=12)
    assert accepted.count() == 3 and refused.count() == 7


def test_document_table(spark, tmp_path):
    table = uploads.DocumentTable(spark, str(tmp_path / "docs"))
    assert table.list().count() == 0
    table.add(spark.createDataFrame([("d1", "a.pdf", "x"), ("d2", "b.pdf", "y")], "document_id string, filename string, sha256 string"))
    table.remove("d1")
    assert [r.document_id for r in table.list().collect()] == ["d2"]
    assert table.get("d1").count() == 0


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", "measured", 50.0, "%", 1, 2, None)], reports.METRICS)
    reports.write_report(df, str(tmp_path / "r"))
    assert reports.read_report(spark, str(tmp_path / "r")).collect() == df.collect()


def test_stream_gives_the_batch_result(spark, tmp_path):
    text = "6.5 Rules for plots\n" + "i. Plots keep a margin of 4.5 m. " * 8
    (tmp_path / "in").mkdir()
    for i in (1, 2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"document_id": "d", "page_number": i, "raw_text": text if i == 1 else "scan"}))
    q = ingest_stream(arriving_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "progress"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.page_quality for r in rows) == ["clean", "unreadable"]
    assert {r.section_number for r in rows} == {"6.5", None}


def test_store_of_recordings(spark, tmp_path):
    """Round trip, newest of each key, and a look-up that opens the buckets of its keys only."""
    store = R.RecordingStore(spark, str(tmp_path / "store"), buckets=16)
    columns = "provider string, endpoint string, query map<string,string>, captured_at timestamp, key string, payload string"
    place = lambda *at: json.dumps([{"lat": str(x)} for x in at])
    at = lambda day: dt.datetime(2026, 9, day)
    first = [("nominatim", "e", {"q": str(i)}, at(1), f"k{i}", place(i)) for i in range(40)] + [("nominatim", "e", None, at(1), None, "[]")]
    later = [("nominatim", "e", {"q": str(i)}, at(2), f"k{i}", place(i, 2)) for i in range(0, 40, 4)] + [("nominatim", "e", None, at(2), "k4", place(4, 3))]
    store.append(spark.createDataFrame(first, columns))
    store.append(spark.createDataFrame(later, columns))
    asked = spark.createDataFrame([("k1", "nominatim"), ("k4", "nominatim"), ("k4", "nominatim"), ("none", "nominatim"), (None, "nominatim")], "key string, provider string")
    want = {"k1": place(1), "k4": place(4, 3)}
    found = store.for_requests(asked)
    assert {r.key: r.payload for r in found.collect()} == want
    # The scan is told the buckets of the three keys, of sixteen.
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = {int(n) for n in re.search(r"PartitionFilters: \[.*?bucket#\d+ (?:IN \(|= )([\d,]+)", plan).group(1).split(",")}
    assert pruned == {r.bucket for r in asked.where("key IS NOT NULL").select(store._bucket()).collect()} and len(pruned) <= 3
    store.compact()
    assert store.all().count() == 40 and {r.key: r.payload for r in store.for_requests(asked).collect()} == want
    store.append(spark.createDataFrame([("nominatim", "e", None, at(3), "k1", place(9))], columns))
    store.compact()
    assert {r.key: r.payload for r in store.for_requests(asked).collect()} == want | {"k1": place(9)} and store.all().count() == 40
    live = spark.createDataFrame([], "key string, attempt int, endpoint string, ok boolean, payload string, error string, retrieved_at timestamp")
    chosen = R.choose_responses(asked.where("key IS NOT NULL").distinct(), store.for_requests(asked), live, F.lit(dt.datetime(2026, 9, 4)))
    assert {r.key: r.ok for r in chosen.collect()} == {"k1": True, "k4": True, "none": False}
