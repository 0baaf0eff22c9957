"""Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One table of a folder.

    With `spread`, a table that is read as one partition, and so is no larger than
    one, is dealt out to all cores before heavy per-row work.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() == 1:
        df = df.repartition(cores)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of the file system it belongs to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
