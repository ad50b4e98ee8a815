"""Helpers shared by the text operators: tables, staging and bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_dir, staged  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())
