"""Scans, projections and three-valued predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import compat as C
from granary.operators import rewrite as R
from granary.plans.sqltext import both, pairs
from granary.sources import catalog
from granary.sources.tables import TABLES, register, table

#: Small table with nulls and padding; both dialects read it.
NULLS = "(VALUES (1, 10, 'abc'), (2, NULL, 'a%c'), (3, 30, NULL), (4, 10, 'abc  '), (5, -7, 'xyz'), (6, NULL, '')) AS t(id, a, s)"

SAME = {
    "scan_count": "SELECT count(*) AS n FROM lineitem",
    "scan_filtered_count": "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10 AND l_shipdate >= TIMESTAMP '1996-01-01'",
    "project_expr": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled, l_extendedprice - l_discount AS net FROM lineitem",
    "project_star": "SELECT * FROM nation",
    "filter_cmp": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND NOT (o_custkey < 10)",
    "filter_columns": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 1 > l_linenumber * 10",
    "filter_case": "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 200000 ELSE o_totalprice > 300000 END",
    "filter_function": "SELECT c_custkey, c_name FROM customer WHERE upper(c_mktsegment) = 'BUILDING' AND char_length(c_name) > 5",
    "pred_in_notin_null": f"SELECT id, a IN (10, NULL) AS inn, a NOT IN (10, 20) AS nin, a NOT IN (10, NULL) AS nnull FROM {NULLS}",
    "pred_between": f"SELECT id, a BETWEEN 0 AND 20 AS b, a NOT BETWEEN 0 AND 20 AS nb FROM {NULLS}",
    "pred_like_escape": f"SELECT id, s LIKE 'a#%c' ESCAPE '#' AS esc, s LIKE 'a%' AS pre, s NOT LIKE '_b_' AS neg FROM {NULLS}",
    "pred_distinct_from": f"SELECT id, a IS DISTINCT FROM 10 AS d, a IS NOT DISTINCT FROM NULL AS n FROM {NULLS}",
    "pred_is_null": f"SELECT id, a IS NULL AS n, s IS NOT NULL AS k FROM {NULLS}",
    "pred_bool_value": f"SELECT id, a > 5 AS gt, a > 5 AND s = 'abc' AS both_true, a > 5 OR s IS NULL AS one, NOT (a > 5) AS neg FROM {NULLS}",
    "pred_boolean_is": f"SELECT id FROM {NULLS} WHERE (a > 5) IS NOT TRUE",
    "pred_boolean_unknown": f"SELECT id, (a > 5) IS NULL AS unknown, (a > 5) IS FALSE AS is_false, (a > 5) IS NOT FALSE AS not_false FROM {NULLS}",
    "pred_bare_boolean": f"SELECT id FROM (SELECT id, a > 5 AS flag FROM {NULLS}) x WHERE flag",
    "pred_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "pred_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "pred_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "pred_notin_subquery": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07)",
    "pred_notin_null_subquery": f"SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT a FROM {NULLS})",
    "pred_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "pred_temporal": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30' AND CAST(o_orderdate AS DATE) <> DATE '1995-02-01'",
    "pred_approximate": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.05 AND l_tax >= 2e-2 AND l_quantity < 1.05e1",
    "view_query": "WITH v AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 0) SELECT k, bal FROM v WHERE bal < 9000",
    "derived_table": "SELECT x.seg, x.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) x WHERE x.n > 1",
    "single_row": "SELECT 1 AS one, 'a' AS letter",
}

DIFFER = {
    "pred_starting": (
        "SELECT c_custkey, startswith(c_name, 'Customer#0000001') AS st, startswith(CAST(c_custkey AS STRING), '1') AS num FROM customer",
        "SELECT c_custkey, starts_with(c_name, 'Customer#0000001') AS st, starts_with(CAST(c_custkey AS VARCHAR), '1') AS num FROM customer",
    ),
    "pred_int_like": ("SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS STRING) LIKE '1%2'", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '1%2'"),
}


def pred_similar(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return rows.select("p_partkey", C.similar_to(F.col("p_brand"), "Brand#(1|2)[[:DIGIT:]]").alias("a"), C.similar_to(F.col("p_type"), "%(STEEL|BRASS)").alias("b"), C.similar_to(F.col("p_type"), "_{3,10} %").alias("c"))


def pred_any_all(spark: SparkSession, folder: str) -> DataFrame:
    values = table(spark, folder, "orders").filter("o_totalprice > 250000").select(F.col("o_totalprice").alias("v"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    out = customers
    for name, f, op, scale in (("any_gt", R.compare_any, ">", 40), ("all_lt", R.compare_all, "<", 40), ("all_ge", R.compare_all, ">=", 60), ("any_eq", R.compare_any, "=", 1), ("all_ne", R.compare_all, "<>", 1)):
        out = f(out, F.col("c_acctbal") * scale, op, values, "v", name)
    return out.drop("c_acctbal")


def pred_any_all_null(spark: SparkSession, folder: str) -> DataFrame:
    t = spark.sql(f"SELECT * FROM {NULLS}")
    out = t.select("id", "a")
    for name, f, op in (("any_lt", R.compare_any, "<"), ("all_lt", R.compare_all, "<"), ("any_eq", R.compare_any, "="), ("all_ne", R.compare_all, "<>")):
        out = f(out, F.col("a"), op, t, "a", name)
    empty = t.filter("id > 99")
    return R.compare_all(R.compare_any(out, F.col("a"), ">", empty, "a", "any_empty"), F.col("a"), ">", empty, "a", "all_empty").drop("a")


def pred_singular(spark: SparkSession, folder: str) -> DataFrame:
    found = R.singular(table(spark, folder, "customer"), ["c_custkey"], table(spark, folder, "orders").filter("o_totalprice > 150000"), ["o_custkey"])
    return found.select("c_custkey")


def pred_pad_equal(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {NULLS}").filter(C.pad_eq(F.col("s"), F.lit("abc "))).select("id")


def parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters on either side, in IN lists, patterns and ranges."""
    register(spark, folder, ["customer"])
    return spark.sql(
        "SELECT c_custkey FROM customer WHERE c_acctbal > :least AND c_mktsegment IN (:a, :b) AND c_name LIKE :pattern AND c_nationkey BETWEEN :low AND :high",
        args={"least": 1000.0, "a": "BUILDING", "b": "MACHINERY", "pattern": "Customer%", "low": 3, "high": 20},
    )


def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog as a relation."""
    return catalog.fields(spark, folder, TABLES[:7]).groupBy("relation").agg(F.count("*").alias("fields"), F.min("field").alias("first_name"))


_V = "(SELECT o_totalprice FROM orders WHERE o_totalprice > 250000)"
QUERIES_A, ORACLES_A = both(SAME)
QUERIES_B, ORACLES_B = pairs(DIFFER)
QUERIES = QUERIES_A | QUERIES_B | {f.__name__: f for f in (pred_similar, pred_any_all, pred_any_all_null, pred_singular, pred_pad_equal, parameters, catalog_tables)}
ORACLES = ORACLES_A | ORACLES_B | {
    "pred_similar": "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#(1|2)[0-9]') AS a, regexp_full_match(p_type, '.*(STEEL|BRASS)') AS b, regexp_full_match(p_type, '.{3,10} .*') AS c FROM part",
    "pred_any_all": f"SELECT c_custkey, c_acctbal * 40 > ANY {_V} AS any_gt, c_acctbal * 40 < ALL {_V} AS all_lt, c_acctbal * 60 >= ALL {_V} AS all_ge, c_acctbal = ANY {_V} AS any_eq, c_acctbal <> ALL {_V} AS all_ne FROM customer",
    "pred_any_all_null": f"WITH t AS (SELECT * FROM {NULLS}) SELECT id, a < ANY (SELECT a FROM t) AS any_lt, a < ALL (SELECT a FROM t) AS all_lt, a = ANY (SELECT a FROM t) AS any_eq, a <> ALL (SELECT a FROM t) AS all_ne, a > ANY (SELECT a FROM t WHERE id > 99) AS any_empty, a > ALL (SELECT a FROM t WHERE id > 99) AS all_empty FROM t",
    "pred_singular": "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) = 1",
    "pred_pad_equal": f"SELECT id FROM {NULLS} WHERE rtrim(s) = 'abc'",
    "parameters": "SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE 'Customer%' AND c_nationkey BETWEEN 3 AND 20",
    "catalog_tables": "SELECT table_name AS relation, count(*) AS fields, min(column_name) AS first_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem') GROUP BY table_name",
}
