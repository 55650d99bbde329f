"""Columnar tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as it is stored; the number of splits is the scan settings' matter."""
    return spark.read.parquet(path)
