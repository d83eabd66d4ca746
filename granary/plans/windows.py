"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import rewrite as R
from granary.plans.sqltext import both
from granary.sources.tables import table

W = "(VALUES (1, 1, 1, 10), (2, 1, 1, 20), (3, 1, 2, NULL), (4, 2, 1, 5), (5, 2, 3, 5), (6, 2, 3, 7), (7, NULL, 4, 1), (8, 1, NULL, 3)) AS t(id, g, h, v)"

SAME = {
    "win_partition": "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS top, sum(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS s FROM customer",
    "win_rank": f"SELECT id, row_number() OVER (PARTITION BY g ORDER BY h NULLS FIRST, id) AS rn, rank() OVER (PARTITION BY g ORDER BY h NULLS FIRST) AS rk, dense_rank() OVER (PARTITION BY g ORDER BY h NULLS FIRST) AS dr FROM {W}",
    "win_running": f"SELECT id, sum(v) OVER (PARTITION BY g ORDER BY h NULLS FIRST) AS s, count(*) OVER (PARTITION BY g ORDER BY h NULLS FIRST) AS n FROM {W}",
    "win_running_table": "SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2, -1) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_value_fns": f"SELECT id, first_value(v) OVER (PARTITION BY g ORDER BY h NULLS FIRST, id) AS f, last_value(v) OVER (PARTITION BY g ORDER BY h NULLS FIRST) AS l_any, nth_value(id, 2) OVER (PARTITION BY g ORDER BY h NULLS FIRST, id) AS n2 FROM (SELECT id, g, h, coalesce(h, 0) AS v FROM {W}) x",
    "win_rows": f"SELECT id, sum(v) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, count(v) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS early, sum(id) OVER (ORDER BY id ROWS 2 PRECEDING) AS s3, min(v) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {W}",
    "win_rows_values": f"SELECT id, first_value(id) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS f, last_value(id) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS l FROM {W}",
    "win_range": f"SELECT id, count(*) OVER (PARTITION BY g ORDER BY h NULLS FIRST RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, sum(v) OVER (ORDER BY id RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM {W}",
    "win_named": f"SELECT id, sum(v) OVER w AS s, count(*) OVER w AS n FROM {W} WINDOW w AS (PARTITION BY g ORDER BY id)",
    "win_top_per_group": "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) x WHERE place <= 3",
    "win_over_group": "SELECT n_regionkey, n, sum(n) OVER (ORDER BY n_regionkey) AS running FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) x",
}


def win_distinct(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return R.count_distinct_partition(rows, ["l_suppkey"], F.col("l_returnflag"), "flags").select("l_orderkey", "l_linenumber", "flags")


def win_distinct_frame(spark: SparkSession, folder: str) -> DataFrame:
    """COUNT(DISTINCT) over a frame of rows."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return table(spark, folder, "orders").select("o_orderkey", R.count_distinct_over(F.col("o_orderpriority"), w).alias("kinds"))


def win_filter(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    late = F.col("o_orderstatus") == "F"
    return table(spark, folder, "orders").select("o_orderkey", R.filtered_over(F.max, F.col("o_totalprice"), late, w).alias("top"), R.filtered_over(F.count, F.lit(1), late, w).alias("n"))


def win_avg_int(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    return table(spark, folder, "part").select("p_partkey", F.call_function("div", F.sum(F.col("p_size").cast("bigint")).over(w), F.count("p_size").over(w)).alias("avg_size"))


QUERIES, ORACLES = both(SAME)
QUERIES |= {f.__name__: f for f in (win_distinct, win_distinct_frame, win_filter, win_avg_int)}
ORACLES |= {
    "win_distinct": "SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) OVER (PARTITION BY l_suppkey) AS flags FROM lineitem",
    "win_distinct_frame": "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS kinds FROM orders",
    "win_filter": "SELECT o_orderkey, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER w AS top, count(*) FILTER (WHERE o_orderstatus = 'F') OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_avg_int": "SELECT p_partkey, (sum(p_size) OVER w // count(p_size) OVER w)::BIGINT AS avg_size FROM part WINDOW w AS (PARTITION BY p_brand)",
}
