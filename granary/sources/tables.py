"""Parquet tables of a dataset folder, as DataFrames and as views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Names of the tables a dataset folder may hold.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; the path goes to Spark's reader unchanged, so any Hadoop file system works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> None:
    """Make the named tables available to spark.sql() as temporary views."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
