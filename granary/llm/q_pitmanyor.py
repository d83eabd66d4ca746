"""Query of the fifth operator. Sampled seats give its scores, so there is no SQL for them; tests check the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import pitmanyor
from granary.llm.common import remainder
from granary.sources.tables import table

MODULUS, HELD = 7, 2


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), MODULUS) == HELD)


QUERIES = {"op5_pitman_yor": op5_pitman_yor}
ORACLES: dict[str, str] = {}
