"""Session defaults that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; everything else is left to the cluster.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "1024",
}

#: Settings that only change plans.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SEMANTICS to a session that somebody else built."""
    for key, value in SEMANTICS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "granary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with all defaults; conf overrides them (dots written as dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PLANNING, **SEMANTICS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
