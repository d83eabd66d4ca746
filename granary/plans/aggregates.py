"""Grouping and aggregates, with integer and decimal averages cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import compat as C
from granary.plans.sqltext import both
from granary.sources.tables import table

T = "(VALUES (1, 1, 7, CAST(1.50 AS DECIMAL(9,2))), (2, 1, 8, 2.25), (3, 2, NULL, NULL), (4, 2, -5, -1.05), (5, 2, -4, 0.10), (6, NULL, 3, 9.99)) AS t(id, g, a, n)"

SAME = {
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top, sum(l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey + l_linenumber) AS combos FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_totalprice) FILTER (WHERE o_custkey % 2 = 0) AS top, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_expr": "SELECT c_nationkey, sum(c_custkey + 1) AS s, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS positive, max(upper(c_mktsegment)) AS seg FROM customer GROUP BY c_nationkey",
    "agg_inside_expr": "SELECT p_brand, max(p_size) - min(p_size) AS spread, count(*) + 1 AS n1, sum(p_size) * 2 AS dbl FROM part GROUP BY p_brand",
    "group_expr": "SELECT year(o_orderdate) AS y, o_custkey % 3 AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_custkey % 3",
    "group_ordinal": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
    "group_null_key": f"SELECT g, count(*) AS n, sum(a) AS s FROM {T} GROUP BY g",
    "group_const": "SELECT 42 AS answer, r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "having_hidden": "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 3 AND max(c_acctbal) > 5000",
    "having_global": "SELECT count(*) AS n FROM region HAVING count(*) > 100",
    "having_subquery": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > (SELECT count(*) / (SELECT count(*) FROM supplier) FROM lineitem)",
    "agg_empty": "SELECT count(*) AS n, count(p_size) AS k, sum(p_size) AS s, min(p_name) AS low FROM part WHERE p_partkey < 0",
    "agg_nulls": f"SELECT count(*) AS n, count(a) AS k, count(DISTINCT a) AS d, min(a) AS low, max(n) AS high FROM {T}",
    "agg_distinct_sum": f"SELECT g, sum(DISTINCT a) AS s, min(DISTINCT a) AS low FROM {T} GROUP BY g",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_statistics": "SELECT round(stddev_samp(c_acctbal), 6) AS sd, round(var_pop(c_acctbal), 4) AS vp, round(corr(c_acctbal, c_custkey), 9) AS r FROM customer",
}


def agg_avg_trunc(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM {T}")
    return rows.groupBy("g").agg(C.avg_int(F.col("a")).alias("avg_a"), C.avg_dec(F.col("n"), 2).alias("avg_n"))


def agg_avg_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").groupBy("p_brand").agg(C.avg_int(F.col("p_size")).alias("avg_size"), C.avg_dec(F.col("p_retailprice").cast("decimal(12,2)"), 2).alias("avg_price"))


def agg_sum_wide(spark: SparkSession, folder: str) -> DataFrame:
    """A sum of 64-bit integers beyond 64 bits."""
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(C.sum_wide(F.col("o_orderkey") + F.lit(9_000_000_000_000_000_000 - 10**9)).alias("total"))


def agg_list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


def agg_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


QUERIES, ORACLES = both(SAME)
QUERIES |= {f.__name__: f for f in (agg_avg_trunc, agg_avg_table, agg_sum_wide, agg_list, agg_pricing_summary)}
ORACLES |= {
    "agg_avg_trunc": f"SELECT g, avg_a, CAST(sign(cents) * (abs(cents) // k) / 100 AS DECIMAL(38,2)) AS avg_n FROM (SELECT g, CASE WHEN sum(a) < 0 THEN -(-sum(a) // count(a)) ELSE sum(a) // count(a) END::BIGINT AS avg_a, CAST(sum(n) * 100 AS BIGINT) AS cents, count(n) AS k FROM {T} GROUP BY g)",
    "agg_avg_table": "SELECT p_brand, (sum(p_size) // count(*))::BIGINT AS avg_size, CAST(CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) * 100 AS BIGINT) // count(*) / 100.0 AS DECIMAL(38,2)) AS avg_price FROM part GROUP BY p_brand",
    "agg_sum_wide": "SELECT o_orderstatus, CAST(sum(CAST(o_orderkey AS HUGEINT) + 8999999999000000000) AS DECIMAL(38,0)) AS total FROM orders GROUP BY o_orderstatus",
    "agg_list": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "agg_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
}
