import zlib

import pytest
from odd_rows import ROWS, clashing, folder, table
from pyspark.sql import functions as F

from lacuna.llm import sharding as S


def loads(rows):
    out = {}
    for r in rows:
        out[r.shard] = out.get(r.shard, 0) + r.size
    return out


def test_contract_on_odd_rows(spark, tmp_path):
    rows = S.op2_sharding(spark, folder(clashing(table(spark)), tmp_path)).collect()
    got = sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) if r.doc_id is not None else (False, 0, r.size, r.text_crc32) for r in rows)
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert got == want
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_empty_table(spark, tmp_path):
    assert S.op2_sharding(spark, folder(table(spark, []), tmp_path)).collect() == []


def test_bytes_are_near_equal_and_slots_stay(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 700 AS int))").alias("text"))
    sized = S.records(docs).cache()
    sizes = S.slot_sizes(sized)
    first = S.edit_map(sizes, 16).cache()
    at16 = loads(S.place(sized, first).collect())
    assert len(at16) == 16 and max(at16.values()) - min(at16.values()) <= 700
    # Growing moves slots into the new shard only, and not more than its share.
    grown = S.edit_map(sizes, 17, first)
    moved = first.alias("a").join(grown.alias("b"), "virtual_slot").where("a.shard != b.shard").select("b.shard", "b.bytes", "b.map_version").collect()
    total = sum(at16.values())
    assert {r.map_version for r in moved} == {2} and sum(r.bytes for r in moved) < total / 17 * 1.5
    shrunk = S.edit_map(sizes, 15, first)
    assert {r.shard for r in shrunk.collect()} == set(range(15))


def test_map_versions_are_kept(spark, tmp_path):
    sizes = spark.createDataFrame([(i, 100 + i, 1) for i in range(40)], "virtual_slot int, bytes long, rows long")
    first = S.edit_map(sizes, 4)
    S.write_map(first, f"{tmp_path}/maps")
    S.write_map(S.edit_map(sizes, 5, S.read_map(spark, f"{tmp_path}/maps")), f"{tmp_path}/maps")
    assert S.read_map(spark, f"{tmp_path}/maps").agg(F.max("shard")).first()[0] == 4
    assert S.read_map(spark, f"{tmp_path}/maps", 1).agg(F.max("shard")).first()[0] == 3


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_on_tables(spark, size):
    rows = S.op2_sharding(spark, f"/root/testdata/sf{size}").collect()
    sums = loads(rows)
    assert set(sums) == set(range(16)) and {r.law for r in rows} == {"bytes"}
    assert max(sums.values()) - min(sums.values()) <= max(r.size for r in rows)
