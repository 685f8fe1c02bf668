"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table (a file or a folder of files) called name; the scan sees every later filter and projection."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
