"""Streaming over the events table: event-time windows, sessions and deduplication.

The batch form of each operator is the same plan; run_once() drives the streaming form over files that
are there, with a watermark, into files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import scratch

LATE = "10 minutes"


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type. Windows start on the hour of UTC, as the session's zone is UTC."""
    grouped = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    grouped = events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    grouped = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


def read(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """events as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def run_once(spark: SparkSession, folder: str, operator: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Rows of the operator over all files that are there now. Checkpoint and result lie in the folder that executors share."""
    out = operator(read(spark, folder))
    place = scratch.folder(spark, "stream")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    # in complete mode each batch gives the whole result; written under the batch's number, a batch that is run again writes the same
    batches: list[int] = []

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/result/batch={batch}")
        batches.append(batch)

    writer.foreachBatch(put).start().awaitTermination()
    wanted = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(out.schema).parquet(*(f"{place}/result/batch={b}" for b in wanted)) if wanted else spark.createDataFrame([], out.schema)
