"""The catalog as relations: tables and fields of a dataset folder, to be joined and grouped like any others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.sources.tables import TABLES, table


def fields(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """relation, field, place (from 0), type: one row for each column; their number depends on schemas alone."""
    rows = [(t, f.name, i, f.dataType.simpleString()) for t in names for i, f in enumerate(table(spark, folder, t).schema.fields)]
    return spark.createDataFrame(rows, "relation string, field string, place int, type string")


def relations(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """relation, kind: one row for each table."""
    return spark.createDataFrame([(t, "table") for t in names], "relation string, kind string")


def register_catalog(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Views catalog_relations and catalog_fields."""
    relations(spark, folder, names).createOrReplaceTempView("catalog_relations")
    fields(spark, folder, names).createOrReplaceTempView("catalog_fields")
