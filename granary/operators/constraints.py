"""Constraints as queries: each gives the rows that violate one. Also sequences, identities and referential actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import written


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """CHECK: violated where the condition is false, not where it is unknown."""
    return df.filter(~condition)


def not_null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a null among the keys never collide."""
    full = df
    for k in keys:
        full = full.filter(F.col(k).isNotNull())
    return full.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def primary_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with a null, or that occur more than once."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null)


def foreign_key_violations(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Child rows whose keys are all non-null and have no parent."""
    full = child
    for k in keys:
        full = full.filter(F.col(k).isNotNull())
    named = parent.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)))
    return full.join(named, [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(keys)], "left_anti")


def on_delete(child: DataFrame, keys: list[str], gone: DataFrame, gone_keys: list[str], action: str, default: Column | None = None) -> DataFrame:
    """child after its parents in gone went: action is cascade, set null or set default."""
    named = gone.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(gone_keys))).distinct().withColumn("_gone", F.lit(True))
    condition = [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(keys)]
    if action == "cascade":
        return child.join(named, condition, "left_anti")
    value = F.lit(None) if action == "set null" else default
    joined = child.join(named, condition, "left")
    return joined.select(*(F.when(F.col("_gone"), value).otherwise(F.col(c)).cast(child.schema[c].dataType).alias(c) if c in keys else F.col(c) for c in child.columns))


def with_sequence(df: DataFrame, name: str, order: list[str], start: int = 1, step: int = 1) -> DataFrame:
    """NEXT VALUE FOR a sequence, by row in the given order. Numbers follow each other without gaps.

    Rows are range-partitioned, sorted and written once with their partition's number, so that counts and rows speak of the
    same partitions; only the counts are gathered, and no task ever holds all rows. The order must be total for the
    numbers to be the same each time.
    """
    placed = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "sequence")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    numbered = placed.withColumn("_r", within).join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return numbered.withColumn(name, F.lit(start) + (F.col("_before") + F.col("_r") - 1) * F.lit(step)).drop("_p", "_q", "_r", "_before")
