"""Tables that a plan writes for itself, in a folder that all executors share, and files that others wrote."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new place in spark.checkpoint.dir, or where that is unset and all runs in one process (tests) in a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, so that every reader sees the same rows in the same place."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(target: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """INSERT into a table of files at path, which starts as target: the table as it is then."""
    target.write.mode("ignore").parquet(path)
    rows.select(*target.columns).write.mode("append").parquet(path)
    return target.sparkSession.read.schema(target.schema).parquet(path)


def external(spark: SparkSession, path: str, schema: str, kind: str = "csv", **options: str) -> DataFrame:
    """An external table: files of the given kind, read by a declared schema; a row that does not fit it raises."""
    return spark.read.schema(schema).options(mode="FAILFAST", **options).format(kind).load(path)
