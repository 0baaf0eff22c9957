"""Coverage and unreadable runs of documents whose pages keep arriving, in any order.

State is kept per document and stretch of pages: which pages were seen, which of them
cannot be read, and sums over them.  It is of fixed size, a hot document is many keys,
and a page that comes again changes nothing.  Each micro-batch writes the rows of the
stretches that it changed, under its own number, so a repeated batch writes the same
rows again; readers take the newest row of each stretch and join runs across stretches.

Pages without a document or number are left out; a document's pages may be numbered
from anywhere.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lacuna import values as V
from lacuna.operators import pages as P
from lacuna.operators.ranges import islands

#: Pages whose state is kept together.
STRETCH = 4096
STATE = "seen binary, unreadable binary, sums array<long>"
ROWS = "document_id string, stretch long, pages long, unreadable array<long>, sums array<long>"
SUMS = ["total_chars", "total_substitutions", "pages_needing_repair", *(f"n_{q}" for q in V.PAGE_QUALITIES)]


def _merged(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        seen, unreadable, sums = state.get
        seen, unreadable, sums = np.frombuffer(seen, bool).copy(), np.frombuffer(unreadable, bool).copy(), np.array(sums, np.int64)
    else:
        seen, unreadable, sums = np.zeros(STRETCH, bool), np.zeros(STRETCH, bool), np.zeros(len(SUMS), np.int64)
    for b in batches:
        # Of a page that comes twice, the first counts.
        b = b.drop_duplicates("at")
        b = b[~seen[b["at"].to_numpy()]]
        at = b["at"].to_numpy()
        seen[at] = True
        unreadable[at] = ~b["readable"].to_numpy(bool)
        sums += b[SUMS].to_numpy(np.int64).sum(axis=0)
    state.update((seen.tobytes(), unreadable.tobytes(), sums.tolist()))
    first = int(key[1]) * STRETCH
    yield pd.DataFrame({"document_id": [key[0]], "stretch": [key[1]], "pages": [int(seen.sum())],
                        "unreadable": [(np.flatnonzero(unreadable) + first).tolist()], "sums": [sums.tolist()]})


def coverage_stream(pages: DataFrame, out: str, progress: str) -> StreamingQuery:
    """Keep the coverage of arriving pages(document_id, page_number, raw_text) under `out`.

    `progress` is a lasting folder of this stream, by which a restart knows what is done.
    """
    known = pages.where("document_id IS NOT NULL AND page_number IS NOT NULL")
    graded = P.grade_pages(known.select("document_id", F.col("page_number").cast("long").alias("page_number"), "raw_text"))
    amounts = {"total_chars": F.col("char_count"), "total_substitutions": F.col("substitutions"), "pages_needing_repair": (F.col("substitutions") > 0),
               **{f"n_{q}": F.col("quality") == q for q in V.PAGE_QUALITIES}}
    keyed = graded.select(
        "document_id", F.floor(F.col("page_number") / STRETCH).cast("long").alias("stretch"), F.pmod("page_number", F.lit(STRETCH)).cast("int").alias("at"),
        P.is_readable().alias("readable"), *(c.cast("long").alias(n) for n, c in amounts.items()))
    changed = keyed.groupBy("document_id", "stretch").applyInPandasWithState(_merged, ROWS, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def _newest(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.schema(f"{ROWS}, batch long").option("basePath", out).parquet(f"{out}/batch=*")
    return rows.groupBy("document_id", "stretch").agg(F.max_by(F.struct("pages", "unreadable", "sums"), "batch").alias("s")).select("document_id", "stretch", "s.*")


def read_coverage(spark: SparkSession, out: str) -> DataFrame:
    """pages.coverage_report of all pages that have arrived."""
    summed = _newest(spark, out).groupBy("document_id").agg(
        F.sum("pages").alias("page_count"), F.sum(F.size("unreadable")).alias("unreadable_page_count"),
        *(F.sum(F.col("sums")[i]).alias(n) for i, n in enumerate(SUMS)))
    readable = F.col("page_count") - F.col("unreadable_page_count")
    return summed.select("document_id", "page_count", readable.alias("readable_page_count"), "unreadable_page_count",
                         F.round(readable / F.col("page_count"), 4).alias("text_coverage"), *SUMS)


def read_unreadable_runs(spark: SparkSession, out: str) -> DataFrame:
    """pages.unreadable_runs of all pages that have arrived."""
    pages = _newest(spark, out).select("document_id", F.explode("unreadable").alias("page_number"))
    return islands(pages, "document_id", "page_number").withColumn("page_count", F.col("page_end") - F.col("page_start") + 1)
