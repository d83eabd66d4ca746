"""Query of the third operator. A fitted model gives its rows, so there is no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import langid
from granary.llm.common import remainder
from granary.sources.tables import table

MODULUS, HELD = 4, 2


def learn(docs: DataFrame) -> langid.Model | None:
    return langid.fit(docs.filter(remainder(F.col("doc_id"), MODULUS) != HELD))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "text")
    return langid.identify(rows, learn(docs), keep=["doc_id", "held_out"])


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
