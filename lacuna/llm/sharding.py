"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots, once and for all.  A small table maps
slots to shards; rebalancing or adding shards edits that table, in a new version,
and only the slots that it moves change place.  The table has one row per slot, so
its size is set by the number of slots and not by the data.

Null ids are spread by the text's checksum; null texts count as empty; identical
rows share a slot and are numbered in any order.  An empty table gives an empty
result; a very long text counts by its bytes alone; slots of equal bytes go by number.  Other columns of the input, whatever their names, are not read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import read, whole_text

SLOTS = 4096
SHARDS = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Id, size, checksum and virtual slot of each row; the text goes no further."""
    sized = docs.select(
        "doc_id",
        (F.octet_length(whole_text()) + 1).cast("long").alias("size"),
        F.crc32(whole_text()).cast("long").alias("text_crc32"),
    )
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32")))
    return sized.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))


def slot_sizes(sized: DataFrame) -> DataFrame:
    """Bytes and rows of each slot."""
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def edit_map(sizes: DataFrame, shards: int, previous: DataFrame | None = None) -> DataFrame:
    """The next version of the slot map: virtual_slot, shard, bytes, rows, map_version.

    Of each shard, the largest slots stay up to the mean load; the rest, the slots
    of shards that are no more, and new slots go one by one, largest first, to the
    lightest shard.  The loop is an expression over one row of as many slots as
    there are, whatever the data.
    """
    if previous is None:
        known = sizes.withColumns({"old": F.lit(None).cast("int"), "was": F.lit(0)})
    else:
        old = previous.select("virtual_slot", F.col("shard").alias("old"), F.col("map_version").alias("was"))
        known = sizes.join(F.broadcast(old), "virtual_slot", "left")
    largest_first = Window.partitionBy("old").orderBy(F.desc("bytes"), "virtual_slot")
    mean = F.expr(f"sum(bytes) OVER () / {shards}")
    stays = (F.col("old") < shards) & ((F.col("so_far") <= F.col("mean")) | (F.col("place") == 1))
    placed = (
        known.withColumns({"so_far": F.sum("bytes").over(largest_first), "place": F.row_number().over(largest_first), "mean": mean})
        .withColumn("old", F.when(stays, F.col("old")))
        .agg(
            F.coalesce(F.max("was"), F.lit(0)).alias("map_version"),
            F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "rows", "old")), asc=False).alias("slots"),
        )
    )
    load = f"transform(sequence(0, {shards - 1}), k -> aggregate(filter(slots, s -> s.old = k), 0L, (a, s) -> a + s.bytes))"
    step = (
        "named_struct('load', transform(a.load, (x, i) -> x + if(i = array_position(a.load, array_min(a.load)) - 1, s.bytes, 0L)), "
        "'out', array_append(a.out, cast(array_position(a.load, array_min(a.load)) - 1 AS int)))"
    )
    dealt = f"aggregate(loose, named_struct('load', {load}, 'out', cast(array() AS array<int>)), (a, s) -> {step}).out"
    return (
        placed.withColumn("loose", F.expr("filter(slots, s -> s.old IS NULL)"))
        .withColumn("dealt", F.expr(dealt))
        .withColumn("kept", F.expr("filter(slots, s -> s.old IS NOT NULL)"))
        .select(
            F.col("map_version"),
            F.explode(F.expr(
                "concat(transform(kept, s -> named_struct('s', s, 'shard', s.old)), "
                "transform(loose, (s, i) -> named_struct('s', s, 'shard', dealt[i])))"
            )).alias("m"),
        )
        .select("m.s.virtual_slot", "m.shard", "m.s.bytes", "m.s.rows", (F.col("map_version") + 1).alias("map_version"))
    )


def write_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to the stored maps; versions are never overwritten."""
    slot_map.write.mode("append").partitionBy("map_version").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest unless one is named."""
    maps = spark.read.parquet(folder)
    wanted = F.lit(version) if version is not None else F.lit(maps.agg(F.max("map_version")).first()[0])
    return maps.where(F.col("map_version") == wanted)


def place(sized: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard of each record, and its position there, gapless from 0.

    A slot's records are numbered within the slot and moved on by what the shard's
    earlier slots hold, so no shard is gathered in one task.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select(
        "virtual_slot", "shard", "map_version", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        sized.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "virtual_slot")
        .withColumn("slot", (F.col("offset") + F.col("place")).cast("long"))
        .drop("offset", "place")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = records(read(spark, sf_dir, "documents"))
    return place(sized, edit_map(slot_sizes(sized), SHARDS)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


QUERIES = {"op2_sharding": (op2_sharding, None)}
