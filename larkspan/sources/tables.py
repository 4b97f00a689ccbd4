"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; a file or a folder of parts."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
