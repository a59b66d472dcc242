"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory (one Parquet file or a directory of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
