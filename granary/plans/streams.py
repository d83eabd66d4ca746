"""Event-time queries over events. An extension: batch and streaming forms share one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.sources.tables import table
from granary.streaming import windows as W


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return W.run_once(spark, folder, W.tumbling)


def batch_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return W.sliding(table(spark, folder, "events"))


def batch_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return W.sessions(table(spark, folder, "events"))


QUERIES = {f.__name__: f for f in (stream_tumbling, batch_sliding, batch_sessions)}
ORACLES = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "batch_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start",
    "batch_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
}
