"""Evaluation reports as JSON folders."""

from pyspark.sql import DataFrame, SparkSession

METRICS = (
    "name string, status string, value double, unit string, numerator long, denominator long, "
    "reason_not_measured string"
)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A missing report is an error of the reader, never a table of zeros."""
    return spark.read.schema(METRICS).json(path)
