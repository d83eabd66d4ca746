"""Query of the fourth operator. Reading markup is not a matter of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import mainpath
from granary.sources.tables import table


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpath.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


QUERIES = {"op4_main_text": op4_main_text}
ORACLES: dict[str, str] = {}
