"""Pages that keep arriving, turned into chunks as they come.

Grading and cutting look at one page at a time, so the batch plan runs unchanged
on a stream and needs no state.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lacuna.plans.ask import ingest

PAGES = "document_id string, page_number long, raw_text string"


def arriving_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGES).json(folder)


def ingest_stream(pages: DataFrame, out: str, progress: str) -> StreamingQuery:
    """Append the chunks of new pages to a Parquet folder, each page once.

    `progress` is a lasting folder of this stream, by which a restart knows what is done.
    """
    return (
        ingest(pages)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
