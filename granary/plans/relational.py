"""Scans, joins and aggregates over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import table


def flagship_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Discounted revenue by nation since 1995; the sort and limit become one top-k operator."""
    items = table(spark, folder, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    orders, customers, nations = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return joined.groupBy("n_name").agg(revenue.alias("revenue"), F.count("*").alias("items")).filter("items > 10").orderBy(F.desc("revenue"), "n_name").limit(10)


QUERIES = {"flagship_revenue": flagship_revenue}
ORACLES = {
    "flagship_revenue": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name HAVING count(*) > 10 ORDER BY revenue DESC, n_name LIMIT 10"""
}
