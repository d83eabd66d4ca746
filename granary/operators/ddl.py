"""ALTER TABLE as frames: each gives the table with its new schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_column(df: DataFrame, name: str, kind: str, default: Column | None = None, position: int | None = None) -> DataFrame:
    """ADD name kind [DEFAULT ...]: old rows get the default, or null. position counts from 1."""
    if name in df.columns:
        raise ValueError(f"column {name} is there already")
    out = df.withColumn(name, (F.lit(None) if default is None else default).cast(kind))
    return out if position is None else move_column(out, name, position)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """DROP name; a column that is not there raises."""
    _known(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """ALTER COLUMN old TO new; a name that is taken raises."""
    _known(df, old)
    if new in df.columns:
        raise ValueError(f"column {new} is there already")
    return df.withColumnRenamed(old, new)


def alter_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    """ALTER COLUMN name TYPE kind; a value that does not fit raises."""
    _known(df, name)
    return df.select(*(F.col(c).cast(kind).alias(c) if c == name else F.col(c) for c in df.columns))


def move_column(df: DataFrame, name: str, position: int) -> DataFrame:
    """ALTER COLUMN name POSITION position (from 1; beyond the last one: at the end)."""
    _known(df, name)
    rest = [c for c in df.columns if c != name]
    at = min(max(position - 1, 0), len(rest))
    return df.select(*rest[:at], name, *rest[at:])


def _known(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
