"""Statements that change tables, constraints, sequences and procedures, each as the table that results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import constraints as K
from granary.operators import dml as D
from granary.operators import procedures as P
from granary.plans.sqltext import statement
from granary.sources.tables import table


def _nation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation")


def dml_insert_select(spark: SparkSession, folder: str) -> DataFrame:
    extra = table(spark, folder, "region").select(F.col("r_regionkey") + 100, F.upper("r_name"))
    return D.insert(_nation(spark, folder), extra, ["n_nationkey", "n_name"], {"n_regionkey": F.lit(-1)})


def dml_insert_returning(spark: SparkSession, folder: str) -> DataFrame:
    extra = table(spark, folder, "region").select(F.col("r_regionkey") + 100, "r_name")
    return D.inserted(_nation(spark, folder), extra, ["n_nationkey", "n_name"])


def dml_update(spark: SparkSession, folder: str) -> DataFrame:
    """Both assignments see the old row."""
    return D.update(_nation(spark, folder), F.col("n_regionkey") == 2, {"n_regionkey": F.col("n_nationkey") % 5, "n_nationkey": F.col("n_regionkey") * 1000 + F.col("n_nationkey")})


def dml_update_returning(spark: SparkSession, folder: str) -> DataFrame:
    return D.updated(table(spark, folder, "customer"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}).select("c_custkey", "c_acctbal")


def dml_update_subquery(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of a busy nation: the condition is a semi-join, kept as a flag."""
    busy = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).filter("n > 5").select(F.col("c_nationkey").alias("k"), F.lit(True).alias("busy"))
    joined = table(spark, folder, "supplier").join(busy, F.col("s_nationkey") == F.col("k"), "left")
    return D.update(joined, F.col("busy"), {"s_acctbal": F.col("s_acctbal") + 1}).select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


def dml_delete(spark: SparkSession, folder: str) -> DataFrame:
    return D.delete(table(spark, folder, "supplier"), (F.col("s_acctbal") < 0) | F.lit(None)).select("s_suppkey")


def dml_delete_returning(spark: SparkSession, folder: str) -> DataFrame:
    return D.deleted(table(spark, folder, "supplier"), F.col("s_acctbal") < 3000).select("s_suppkey", "s_name")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    nation = _nation(spark, folder)
    return nation.filter("n_nationkey < 5").select((F.col("n_nationkey") * 10).alias("n_nationkey"), F.concat(F.lit("new "), "n_name").alias("n_name"), "n_regionkey")


def dml_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return D.upsert(_nation(spark, folder), _changes(spark, folder), ["n_nationkey"])


def dml_merge(spark: SparkSession, folder: str) -> DataFrame:
    return D.merge(
        _nation(spark, folder),
        _changes(spark, folder),
        lambda t, s: t("n_nationkey") == s("n_nationkey"),
        lambda t, s: [
            D.Branch(True, "delete", condition=s("n_regionkey") == 1),
            D.Branch(True, "update", {"n_name": s("n_name"), "n_regionkey": t("n_regionkey") + 1}),
            D.Branch(False, "insert", {"n_nationkey": s("n_nationkey"), "n_name": s("n_name")}, s("n_nationkey") > 30),
        ],
    )


def constraint_foreign_key(spark: SparkSession, folder: str) -> DataFrame:
    return K.foreign_key_violations(table(spark, folder, "customer"), ["c_custkey"], table(spark, folder, "orders"), ["o_custkey"]).select("c_custkey")


def constraint_unique(spark: SparkSession, folder: str) -> DataFrame:
    return K.unique_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey"])


def constraint_primary_key(spark: SparkSession, folder: str) -> DataFrame:
    return K.primary_key_violations(table(spark, folder, "lineitem"), ["l_orderkey"])


def constraint_check(spark: SparkSession, folder: str) -> DataFrame:
    return K.check_violations(table(spark, folder, "customer"), F.col("c_acctbal") >= 0).select("c_custkey", "c_acctbal")


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "region").filter("r_regionkey = 1")
    return K.on_delete(_nation(spark, folder), ["n_regionkey"], gone, ["r_regionkey"], "cascade")


def cascade_set_null(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "region").filter("r_regionkey = 1")
    return K.on_delete(_nation(spark, folder), ["n_regionkey"], gone, ["r_regionkey"], "set null")


def sequence_values(spark: SparkSession, folder: str) -> DataFrame:
    return K.with_sequence(table(spark, folder, "customer").select("c_custkey"), "seq", ["c_custkey"], start=100, step=5)


def computed_column(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").withColumn("label", F.concat(F.upper("p_brand"), F.lit(":"), F.col("p_size").cast("string"))).select("p_partkey", "label")


def proc_udtf(spark: SparkSession, folder: str) -> DataFrame:
    """SELECT from a procedure with parameters, ROWS 2 TO 4."""
    P.register(spark)
    return spark.sql("SELECT n, square FROM granary_squares(10) ORDER BY n LIMIT 3 OFFSET 1")


def proc_lateral(spark: SparkSession, folder: str) -> DataFrame:
    P.register(spark)
    table(spark, folder, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_name, n FROM region, LATERAL granary_squares(r_regionkey)")


def proc_loop(spark: SparkSession, folder: str) -> DataFrame:
    """An EXECUTE BLOCK with variables, a loop and a condition."""
    return P.collatz(spark, 27)


def cursor_loop(spark: SparkSession, folder: str) -> DataFrame:
    """FOR SELECT over rows in order with a running state, as a window."""
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return statement("SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0L) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders")(spark, folder)


_CHANGES = "(SELECT n_nationkey * 10 AS k, 'new ' || n_name AS name, n_regionkey AS r FROM nation WHERE n_nationkey < 5)"
QUERIES = {
    f.__name__: f
    for f in (
        dml_insert_select, dml_insert_returning, dml_update, dml_update_returning, dml_update_subquery, dml_delete, dml_delete_returning, dml_upsert, dml_merge,
        constraint_foreign_key, constraint_unique, constraint_primary_key, constraint_check, cascade_delete, cascade_set_null, sequence_values, computed_column, proc_udtf, proc_lateral, proc_loop, cursor_loop,
    )
}
ORACLES = {
    "dml_insert_select": "SELECT * FROM nation UNION ALL SELECT r_regionkey + 100, upper(r_name), -1 FROM region",
    "dml_insert_returning": "SELECT r_regionkey + 100 AS n_nationkey, r_name AS n_name, CAST(NULL AS INT) AS n_regionkey FROM region",
    "dml_update": "SELECT CASE WHEN n_regionkey = 2 THEN n_regionkey * 1000 + n_nationkey ELSE n_nationkey END AS n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN n_nationkey % 5 ELSE n_regionkey END AS n_regionkey FROM nation",
    "dml_update_returning": "SELECT c_custkey, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_acctbal < 0",
    "dml_update_subquery": "SELECT s_suppkey, round(CASE WHEN s_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 5) THEN s_acctbal + 1 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier",
    "dml_delete": "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0)",
    "dml_delete_returning": "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 3000",
    "dml_upsert": f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT k FROM {_CHANGES} c) UNION ALL SELECT * FROM {_CHANGES} c",
    "dml_merge": f"SELECT n_nationkey, coalesce(name, n_name) AS n_name, CASE WHEN k IS NULL THEN n_regionkey ELSE n_regionkey + 1 END AS n_regionkey FROM nation LEFT JOIN {_CHANGES} c ON k = n_nationkey WHERE r IS NULL OR r <> 1 UNION ALL SELECT k, name, NULL FROM {_CHANGES} c WHERE k > 30 AND k NOT IN (SELECT n_nationkey FROM nation)",
    "constraint_foreign_key": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "constraint_unique": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1",
    "constraint_primary_key": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "constraint_check": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0",
    "cascade_delete": "SELECT * FROM nation WHERE n_regionkey <> 1",
    "cascade_set_null": "SELECT n_nationkey, n_name, nullif(n_regionkey, 1) AS n_regionkey FROM nation",
    "sequence_values": "SELECT c_custkey, 95 + 5 * row_number() OVER (ORDER BY c_custkey) AS seq FROM customer",
    "computed_column": "SELECT p_partkey, upper(p_brand) || ':' || p_size AS label FROM part",
    "proc_udtf": "SELECT * FROM (VALUES (2, 4), (3, 9), (4, 16)) AS t(n, square)",
    "proc_lateral": "SELECT r_name, unnest(range(1, r_regionkey + 1))::INT AS n FROM region",
    "proc_loop": "WITH RECURSIVE c(step, x) AS (SELECT 0, 27 UNION ALL SELECT step + 1, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END FROM c WHERE x <> 1) SELECT max(step)::INT AS steps, max(x)::BIGINT AS peak FROM c",
    "cursor_loop": "SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders",
}
