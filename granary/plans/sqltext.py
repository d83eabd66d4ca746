"""Queries given as SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.sources.tables import TABLES, register

Query = Callable[[SparkSession, str], DataFrame]


def statement(text: str) -> Query:
    """A query that runs text over views of the tables it names."""
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder, names)
        return spark.sql(text)

    return run


def both(texts: dict[str, str]) -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and oracles of statements that mean the same in either dialect."""
    return {name: statement(text) for name, text in texts.items()}, dict(texts)


def pairs(texts: dict[str, tuple[str, str]]) -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and oracles of statements written once for each dialect."""
    return {name: statement(ours) for name, (ours, _) in texts.items()}, {name: theirs for name, (_, theirs) in texts.items()}
