"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import rewrite as R
from granary.operators.bands import band_of, close_pairs
from granary.plans.sqltext import both, pairs
from granary.sources.tables import table

EMP = "(VALUES (1, 1, 10, 'ann'), (2, 1, 20, 'bob'), (3, 2, 10, 'cid'), (4, NULL, 30, 'dan'), (5, 99, 20, 'eve'), (6, 3, 30, 'fay')) AS e(id, dept, region, name)"
DEPT = "(VALUES (1, 10, 'dev'), (2, 20, 'ops'), (3, 30, 'hr'), (8, 10, 'void')) AS d(did, dregion, dname)"
NL = "(SELECT * FROM (VALUES (1, 1, 'a'), (2, 2, 'b'), (NULL, 3, 'c'), (4, 4, 'd')) AS l(k, g, lonly))"
NR = "(SELECT * FROM (VALUES (1, 1, 'p'), (2, 9, 'q'), (NULL, 3, 'r')) AS r(k, g, ronly))"
J1 = "(VALUES ('a    ', 1), ('b    ', 2), ('a    ', 3), (NULL, 4)) AS j1(k, v)"
J2 = "(VALUES ('a', 10), ('b', 20), ('b ', 30), (NULL, 40), ('c', 50)) AS j2(k2, w)"

SAME = {
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000",
    "join_multikey": f"SELECT id, did FROM {EMP} JOIN {DEPT} ON dept = did AND region = dregion",
    "join_left": f"SELECT id, did, dname FROM {EMP} LEFT JOIN {DEPT} ON dept = did",
    "join_right": f"SELECT id, did, dname FROM {EMP} RIGHT JOIN {DEPT} ON dept = did",
    "join_full": f"SELECT id, did FROM {EMP} FULL OUTER JOIN {DEPT} ON dept = did",
    "join_full_tables": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON o_custkey = c_custkey",
    "join_left_where": f"SELECT id, dname FROM {EMP} LEFT JOIN {DEPT} ON dept = did AND dregion > 10 WHERE dname IS NULL OR id < 3",
    "join_anti": "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "join_semi": "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "join_theta": "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_theta_or": f"SELECT id, did FROM {EMP} JOIN {DEPT} ON dept = did OR region >= dregion",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_name <> r_name",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_natural": f"SELECT * FROM {NL} NATURAL JOIN {NR}",
    "join_using": "SELECT k, lonly, ronly FROM " + NL + " a JOIN " + NR + " b USING (k)",
    "join_chain": "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_key_families": "SELECT a.x, b.y FROM (VALUES (CAST(1.50 AS DECIMAL(9,2)), DATE '2024-01-01'), (2.00, DATE '2024-01-02')) AS a(x, d) JOIN (VALUES (CAST(1.5 AS DOUBLE), TIMESTAMP '2024-01-01 00:00:00'), (2.0, TIMESTAMP '2024-01-02 10:00:00')) AS b(y, ts) ON CAST(a.x AS DOUBLE) = b.y AND CAST(a.d AS TIMESTAMP) = b.ts",
    "join_derived": "SELECT n_name, t.bal FROM nation JOIN (SELECT c_nationkey, max(c_acctbal) AS bal FROM customer GROUP BY c_nationkey) t ON t.c_nationkey = n_nationkey",
    "join_group": "SELECT n_name, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_expression": "SELECT o_orderkey, upper(c_mktsegment) AS seg, o_totalprice + c_acctbal AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice + c_acctbal > 300000",
    "join_lateral": "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
    "join_left_lateral": "SELECT c_custkey, t.most FROM customer LEFT JOIN LATERAL (SELECT max(o_totalprice) AS most FROM orders WHERE o_custkey = c_custkey) t ON TRUE",
}


def join_text_pad(spark: SparkSession, folder: str) -> DataFrame:
    left, right = spark.sql(f"SELECT * FROM {J1}"), spark.sql(f"SELECT * FROM {J2}")
    return R.text_key_join(left, right, "k", "k2").select("v", "w")


def join_self(spark: SparkSession, folder: str) -> DataFrame:
    return close_pairs(table(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"], band_of(F.col("c_acctbal"), 64), "c_custkey", ("k1", "k2"), "c_acctbal", 50)


def join_band(spark: SparkSession, folder: str) -> DataFrame:
    return close_pairs(table(spark, folder, "part"), ["p_brand"], F.col("p_size"), "p_partkey", ("x", "y"))


def join_left_anti(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").join(table(spark, folder, "lineitem").filter("l_quantity > 40"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


QUERIES_A, ORACLES_A = both(SAME)
QUERIES_B, ORACLES_B = pairs({})
QUERIES = QUERIES_A | QUERIES_B | {"join_text_pad": join_text_pad, "join_self": join_self, "join_band": join_band, "join_left_anti": join_left_anti}
ORACLES = ORACLES_A | ORACLES_B | {
    "join_text_pad": f"SELECT v, w FROM {J1} JOIN {J2} ON rtrim(k) = rtrim(k2)",
    "join_self": "SELECT a.c_custkey AS k1, b.c_custkey AS k2 FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) < 50",
    "join_band": "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON b.p_size BETWEEN a.p_size - 1 AND a.p_size + 1 AND a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand",
    "join_left_anti": "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)",
}
