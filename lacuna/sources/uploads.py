"""Uploaded files: guards and an append-only document table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their size, content and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


def refusal(max_bytes: int | None = None) -> Column:
    """Why a file is not accepted; null when it is.  Sizes are judged only where a limit is given."""
    no_pdf = F.when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "That file is not a PDF.")
    if max_bytes is None:
        return no_pdf
    return F.coalesce(F.when(F.col("length") > max_bytes, F.format_string("File is %.1f MB.", F.col("length") / 1e6)), no_pdf)


def guard(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) files; a file is judged by itself, however many there are."""
    checked = files.withColumn("problem", refusal(max_bytes))
    return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())


def document_id() -> Column:
    return F.concat(F.lit("doc_"), F.left("sha256", F.lit(10)))


class DocumentTable:
    """Append-only record of uploads in a shared folder; removal adds a tombstone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def add(self, documents: DataFrame) -> None:
        """documents(document_id, filename, sha256)."""
        self._append(documents.withColumn("uploaded_at", F.current_timestamp()), "added")

    def remove(self, document_id: str) -> None:
        gone = self.spark.createDataFrame([(document_id,)], "document_id string")
        self._append(gone.withColumn("removed_at", F.current_timestamp()), "removed")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):  # nothing written yet
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def list(self) -> DataFrame:
        """Documents present, the newest first."""
        added = self._read("added", "document_id string, filename string, sha256 string, uploaded_at timestamp")
        removed = self._read("removed", "document_id string, removed_at timestamp")
        gone = removed.groupBy("document_id").agg(F.max("removed_at").alias("removed_at"))
        kept = added.join(gone, "document_id", "left").where(
            F.col("removed_at").isNull() | (F.col("uploaded_at") > F.col("removed_at"))
        )
        return kept.drop("removed_at").orderBy(F.col("uploaded_at").desc())

    def get(self, document_id: str) -> DataFrame:
        return self.list().where(F.col("document_id") == document_id)
