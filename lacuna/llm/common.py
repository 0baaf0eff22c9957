"""What the operators of this folder share."""

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import checkpoint_dir


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is; a null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write a compact result once and read it back.

    Cuts the lineage: a lost executor costs no recomputation, readers see true
    sizes, and several readers do not repeat the work.  Writers and readers hold
    row groups of about `group_bytes`, where given.
    """
    path = shared_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of the file system it belongs to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    """A setting of the session, for what is written inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Arrow batches of so many rows at most, for what is written inside; rows with large arrays need few."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)
