"""Readers for the Parquet tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the directory: one Parquet file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
