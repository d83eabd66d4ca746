"""Query of the ninth operator. Segmentation is not a matter of SQL; tests compare it with the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import pieces
from granary.sources.tables import table


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = pieces.MODEL) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load(model), keep=["doc_id"])


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
