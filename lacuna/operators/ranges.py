"""Order-dependent operators that never put one key's rows in one task.

A window over `partitionBy(key)` sends all rows of a hot key to a single task.
Each operator here works in two levels: rows first meet inside (key, bucket),
where a bucket is a bounded stretch of the ordering column, or a part of a global
order, and only one or two summary rows per bucket meet inside the key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.session import materialise

BUCKET_WIDTH = 1 << 12


def _bucket(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def _join_offsets(df: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys in which null equals null."""
    renamed = offsets.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(renamed, same).drop(*(f"_of_{k}" for k in keys))


def number_rows(df: DataFrame, keys: str | list[str], position: str, out: str, width: int = BUCKET_WIDTH, up_to: int | None = None) -> DataFrame:
    """1-based rank of each row within its keys, by a unique whole-number position.

    Null keys are a key of their own; rows without a position come first.  With `up_to`,
    only rows of the first so many ranks: buckets that begin beyond it are not dealt out.
    """
    keys = [keys] if isinstance(keys, str) else keys
    keyed = df.withColumn("_bucket", _bucket(F.col(position), width))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A row per bucket, stored so that its true size shows and the rows are dealt out once, for ranks alone.
    offsets = materialise(
        keyed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(position)
    rank = F.row_number().over(within)
    if up_to is not None:
        some = _join_offsets(keyed, offsets.where(F.col("_offset") < up_to), [*keys, "_bucket"])
        return some.withColumn(out, F.col("_offset") + rank).where(F.col(out) <= up_to).drop("_bucket", "_offset")
    return (
        _join_offsets(keyed.withColumn("_rank", rank), offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_rank", "_offset")
    )


def dealt_by_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in one global order, dealt out at sampled splitters: `_part` and `_at`, the place in it.

    A key with most of the rows takes up many parts.  Splitters differ from run to run,
    so the rows are stored once with their places, and every reader sees the same.
    """
    place = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialise(place.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))


def rank_rows(
    df: DataFrame, key: str, groups: list[tuple[str, bool]], position: str, out: str
) -> DataFrame:
    """1-based rank within `key` by columns, then by position.

    `groups` lists (column, descending).  Rows are put in order once, over all keys and
    tasks; a row's rank is its place in its part, less the place where its key begins
    there, and the number of the key's rows in earlier parts.  Of a key, one row per
    part meets in one task.  Nulls are values like any other; rows that are equal in
    all these columns take any of their ranks.
    """
    order = [F.col(key).asc(), *(F.col(n).desc() if down else F.col(n).asc() for n, down in groups), F.col(position).asc()]
    dealt = dealt_by_order(df, order)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select(
        key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    return _join_offsets(dealt, offsets, [key, "_part"]).withColumn(out, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def islands(df: DataFrame, key: str, position: str, width: int = BUCKET_WIDTH) -> DataFrame:
    """Maximal runs of consecutive positions per key: (key, page_start, page_end).

    Runs inside a bucket are final unless they touch its edge; only edge runs, at
    most two per bucket, are stitched across buckets.
    """
    rows = df.select(key, F.col(position).cast("long").alias("_at")).distinct()
    rows = rows.withColumn("_bucket", _bucket(F.col("_at"), width))
    within = Window.partitionBy(key, "_bucket").orderBy("_at")
    # Read twice below; what it is made from, often the corpus, is read once.
    local = materialise(
        rows.withColumn("_run", F.col("_at") - F.row_number().over(within))
        .groupBy(key, "_bucket", "_run")
        .agg(F.min("_at").alias("page_start"), F.max("_at").alias("page_end"))
    )
    low = F.col("_bucket") * width
    at_edge = (F.col("page_start") == low) | (F.col("page_end") == low + (width - 1))
    inner = local.where(~at_edge).select(key, "page_start", "page_end")
    across = Window.partitionBy(key).orderBy("page_start")
    starts_run = F.col("page_start") != F.coalesce(F.lag("page_end").over(across) + 1, F.lit(-1))
    stitched = (
        local.where(at_edge)
        .withColumn("_new", starts_run.cast("int"))
        .withColumn("_run", F.sum("_new").over(across))
        .groupBy(key, "_run")
        .agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
        .select(key, "page_start", "page_end")
    )
    return inner.unionByName(stitched)


def latest_before(
    left: DataFrame,
    right: DataFrame,
    key: str,
    position: str,
    value: str,
    out: str,
    width: int,
) -> DataFrame:
    """As-of join: the right row's value at the greatest position <= the left's.

    At equal positions the right row comes first, and the largest value wins.
    """
    union = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(key, position, F.col(value).alias(out)).withColumn("_side", F.lit(0)),
        allowMissingColumns=True,
    )
    union = union.withColumn("_bucket", _bucket(F.col(position), width))
    within = (
        Window.partitionBy(key, "_bucket")
        .orderBy(position, "_side", out)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = F.last(F.when(F.col("_side") == 0, F.col(out)), ignorenulls=True)
    left_buckets = union.where(F.col("_side") == 1).select(key, "_bucket").distinct()
    inside = union.withColumn("_seen", seen.over(within))
    newest = F.max(F.struct(F.col(position).alias("p"), F.col(out).alias("v")))
    right_rows = union.where(F.col("_side") == 0)
    per_bucket = (
        right_rows.groupBy(key, "_bucket").agg(newest.alias("_last"))
        .unionByName(left_buckets, allowMissingColumns=True)
        .groupBy(key, "_bucket").agg(F.max("_last").alias("_last"))
    )
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        key, "_bucket", F.last("_last", ignorenulls=True).over(earlier)["v"].alias("_carried")
    )
    return (
        inside.where(F.col("_side") == 1)
        .join(carried, [key, "_bucket"], "left")
        .withColumn(out, F.coalesce("_seen", "_carried"))
        .drop("_side", "_bucket", "_seen", "_carried")
    )
