"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` (file or directory) of `folder`."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")
