"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet`` (filters and column pruning reach the scan). The
    number of tasks follows the files and their row groups, at any size."""
    return spark.read.parquet(path)
