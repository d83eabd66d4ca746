"""Query of the first operator. Tests compare it with all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import minhash
from granary.sources.tables import table


def op1_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_dartminhash": op1_dartminhash}
ORACLES: dict[str, str] = {}
