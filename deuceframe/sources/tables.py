"""Readers of the parquet tables of one scale folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name`; Catalyst prunes its columns and pushes its filters to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
