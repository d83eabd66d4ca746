"""Query of the tenth operator. Its trees are trained on the table, so no SQL gives its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import pii as P
from granary.llm.common import joined_spans
from granary.sources.tables import table


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.scan(table(spark, sf_dir, "documents"))
    counts = [P.count_kind(found["base"], kind).alias(f"n_{kind}") for kind in P.BASE]
    return found.select("doc_id", *counts, P.digest(found["base"]).alias("base_sha256"), joined_spans(found["spans"]).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
