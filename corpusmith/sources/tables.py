"""Readers for the Parquet tables of a data directory, with the schemas this library expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) of ``directory``."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
