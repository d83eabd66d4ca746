"""Order, limits, set operations, common table expressions and subqueries as values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import rewrite as R
from granary.plans.sqltext import both, pairs
from granary.sources.tables import table

O = "(VALUES (1, 10), (2, NULL), (3, 5), (4, NULL), (5, 7)) AS t(id, a)"  # noqa: E741
ORG = "(VALUES (1, NULL, 'root'), (2, 1, 'a'), (3, 1, 'b'), (4, 2, 'c'), (5, 4, 'd'), (6, NULL, 'alone')) AS o(id, parent, name)"

SAME = {
    "order_nulls": f"SELECT id, a, row_number() OVER (ORDER BY a ASC NULLS FIRST, id) AS up, row_number() OVER (ORDER BY a DESC NULLS FIRST, id) AS down, row_number() OVER (ORDER BY a NULLS LAST, id) AS last FROM {O}",
    "order_keys": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 25",
    "order_expression": "SELECT p_partkey AS k FROM part ORDER BY p_size * -1, p_partkey LIMIT 10",
    "top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20",
    "distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "distinct_null": f"SELECT DISTINCT a FROM {O}",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 3",
    "union_distinct": f"SELECT a FROM {O} UNION SELECT CAST(NULL AS INT) UNION SELECT 7",
    "union_derived": "SELECT x.k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x GROUP BY x.k",
    "intersect_except": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "cte": "WITH big(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) SELECT k, round(total, 2) AS total FROM big JOIN rich ON k = c_custkey",
    "cte_recursive": f"WITH RECURSIVE t(id, depth, path) AS (SELECT id, 0, CAST(name AS VARCHAR(100)) FROM {ORG} WHERE parent IS NULL UNION ALL SELECT o.id, t.depth + 1, CAST(concat(t.path, '/', o.name) AS VARCHAR(100)) FROM {ORG} JOIN t ON o.parent = t.id) SELECT id, depth, path FROM t",
    "cte_recursive_deep": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 500) SELECT count(*) AS n, max(n) AS top FROM r",
    "subq_select": "SELECT n_nationkey, (SELECT count(*) FROM region) AS regions, (SELECT max(r_name) FROM region) AS last_region FROM nation",
    "subq_correlated": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS top FROM customer",
    "subq_exists_value": "SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS has FROM nation",
    "subq_two_levels": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08))",
}


def first_skip(spark: SparkSession, folder: str) -> DataFrame:
    ordered = table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return R.first_skip(ordered, first=7, skip=5)


def rows_to(spark: SparkSession, folder: str) -> DataFrame:
    return R.rows_to(table(spark, folder, "part").select("p_partkey").orderBy(F.desc("p_retailprice"), "p_partkey"), 11, 15)


def order_collated(spark: SparkSession, folder: str) -> DataFrame:
    """Order without regard to case: the keys' places."""
    return spark.sql("SELECT s, row_number() OVER (ORDER BY s COLLATE UNICODE_CI, s) AS place FROM (VALUES ('b'), ('A'), ('a'), ('C'), ('B')) AS t(s)")


QUERIES, ORACLES = both(SAME)
more, theirs = pairs({"offset_fetch": ("SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 3", "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 3")})
QUERIES |= more | {f.__name__: f for f in (first_skip, rows_to, order_collated)}
ORACLES |= theirs | {
    "first_skip": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 5",
    "rows_to": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5 OFFSET 10",
    "order_collated": "SELECT s, row_number() OVER (ORDER BY lower(s), s) AS place FROM (VALUES ('b'), ('A'), ('a'), ('C'), ('B')) AS t(s)",
}
