"""From raw documents to token ids: the stages of a training corpus, each written and read again.

All stages take documents with any further columns, whatever their names; a null or empty text, one without words, a null id,
an id that several rows share, repeated rows and very long texts go through each of them, and an empty table gives an empty one. Rows of one
id are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate as decontamination
from granary.llm import langid, minhash, pieces, q_langid, secrets
from granary.llm.common import forget, stored
from granary.session import configure
from granary.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; lang is the model's answer. Texts that are null or have no letter go."""
    configure(spark)
    # renamed, so that no column of docs is taken for one of the operator's
    renamed = docs.toDF(*(f"doc_{c}" for c in docs.columns))
    found = langid.identify(renamed, q_langid.learn(docs), text_col="doc_text", drop_rejected=True)
    return found.select(*(F.col("lang_pred" if c == "lang" else f"doc_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id; of rows of equal id and text one stays. Texts without words are no copies of each other."""
    configure(spark)
    return minhash.deduplicate(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. A null text has none."""
    configure(spark)
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind in brackets; n_chars is that of the new text, null if it is null."""
    configure(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null or empty text has none."""
    configure(spark)
    return pieces.encode(docs, pieces.load(), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("encoded", encoded),
]

#: Fitted models and segmentation are not a matter of SQL; tests compare run() with a plain run of all stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
