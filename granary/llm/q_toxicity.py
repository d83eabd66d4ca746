"""Query of the second operator. A trained network gives its rows, so there is no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import toxicity
from granary.llm.common import remainder
from granary.sources.tables import table

MODULUS, HELD = 3, 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "text")
    net = toxicity.learn(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), MODULUS) != HELD))
    return toxicity.score(docs, net, keep=["doc_id", "held_out"])


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
