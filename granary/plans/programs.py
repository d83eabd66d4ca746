"""Views, parameters, sinks, external files, cursors, schema changes and procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import constraints as K
from granary.operators import ddl as A
from granary.operators import dml as D
from granary.operators import procedures as P
from granary.operators import rewrite as R
from granary.operators.cursors import Cursor
from granary.sources import catalog, scratch
from granary.sources.tables import TABLES, register, table


def view_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A view that names its columns, and a view over it."""
    register(spark, folder, ["customer"])
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW granary_rich (k, nation, bal) AS SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW granary_richest (nation, n, most) AS SELECT nation, count(*), max(bal) FROM granary_rich WHERE bal > 4000 GROUP BY nation")
    return spark.sql("SELECT r.k, v.n, v.most FROM granary_rich AS r JOIN granary_richest AS v ON r.nation = v.nation AND r.bal = v.most")


def having_parameter(spark: SparkSession, folder: str) -> DataFrame:
    register(spark, folder, ["customer"])
    return spark.sql("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > :least AND max(c_acctbal) > :top", args={"least": 2, "top": 5000.0})


def parameter_null(spark: SparkSession, folder: str) -> DataFrame:
    """A comparison with a null parameter is unknown, on either side, in a list, a pattern or a range."""
    register(spark, folder, ["customer"])
    return spark.sql(
        "SELECT c_custkey, c_acctbal > CAST(:p AS DOUBLE) AS gt, CAST(:p AS DOUBLE) <= c_acctbal AS le, c_mktsegment IN (CAST(:p AS STRING), 'BUILDING') AS listed, "
        "c_name LIKE CAST(:p AS STRING) AS matched, c_custkey BETWEEN 1 AND CAST(:p AS BIGINT) AS ranged FROM customer WHERE c_custkey <> 1 OR CAST(:p AS INT) IS NULL",
        args={"p": None},
    )


def catalog_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog relations joined, filtered and grouped."""
    catalog.register_catalog(spark, folder, TABLES[:8])
    return spark.sql("SELECT r.relation, count(*) AS fields, max(f.field) AS last_name FROM catalog_relations r JOIN catalog_fields f ON r.relation = f.relation WHERE f.field NOT LIKE '%comment%' GROUP BY r.relation HAVING count(*) > 2")


def dml_insert_written(spark: SparkSession, folder: str) -> DataFrame:
    """INSERT into a table of files: written, appended to and read again."""
    nation = table(spark, folder, "nation")
    extra = table(spark, folder, "region").select(F.col("r_regionkey") + 100, "r_name", F.lit(None))
    return scratch.append(nation, D.inserted(nation, extra), scratch.folder(spark, "nation"))


def external_csv(spark: SparkSession, folder: str) -> DataFrame:
    """An external table of text files with a declared schema, joined with an inner one."""
    path = scratch.folder(spark, "external")
    table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.option("header", True).csv(path)
    outer = scratch.external(spark, path, "s_suppkey long, s_nationkey int, s_acctbal double", "csv", header="true")
    return outer.join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))


def external_json(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch.folder(spark, "external")
    table(spark, folder, "part").select("p_partkey", "p_name", "p_size").write.json(path)
    return scratch.external(spark, path, "p_partkey long, p_name string, p_size long", "json").filter("p_size > 10")


def fetch_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A cursor over an ordered query, fetched ten rows at a time."""
    out = []
    with Cursor(table(spark, folder, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name")) as cursor:
        while rows := cursor.fetch(10):
            out.append((len(out), len(rows), rows[0]["n_name"], rows[-1]["n_name"]))
    return spark.createDataFrame(out, "batch int, n int, first_name string, last_name string")


def cursor_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """OPEN, FETCH, CLOSE: the first two rows of a cursor are left out, a running sum goes over the others."""
    total, out = 0, []
    with Cursor(table(spark, folder, "region").orderBy("r_regionkey")) as cursor:
        cursor.fetch(2)
        while rows := cursor.fetch():
            total += rows[0]["r_regionkey"]
            out.append((rows[0]["r_name"], total))
    return spark.createDataFrame(out, "r_name string, total long")


def pred_fallible(spark: SparkSession, folder: str) -> DataFrame:
    """A division by zero in a condition raises; one that no row reaches does not."""
    register(spark, folder, ["lineitem"])
    bad = R.raised(spark.sql("SELECT l_orderkey FROM lineitem WHERE l_orderkey / (l_linenumber - 1) > 2")).withColumnRenamed("raised", "reached")
    return bad.crossJoin(F.broadcast(R.raised(spark.sql("SELECT l_orderkey FROM lineitem WHERE CASE WHEN l_linenumber <> 1 THEN l_orderkey / (l_linenumber - 1) > 2 END")).withColumnRenamed("raised", "guarded")))  # one row


def ddl_alter_table(spark: SparkSession, folder: str) -> DataFrame:
    """Columns added with a default and a place, renamed, dropped and given another type."""
    t = A.add_column(table(spark, folder, "nation"), "n_status", "varchar(10)", F.lit("new"), 1)
    t = A.rename_column(A.alter_type(t, "n_regionkey", "decimal(9,2)"), "n_name", "n_title")
    return A.add_column(A.drop_column(t, "n_nationkey"), "n_note", "string")


def ddl_create_table(spark: SparkSession, folder: str) -> DataFrame:
    """CREATE TABLE with defaults, an INSERT that leaves a column out, and the table read back."""
    made = spark.createDataFrame([], "id int, name string, state string")
    rows = table(spark, folder, "region").select("r_regionkey", "r_name")
    return scratch.append(made, D.inserted(made, rows, ["id", "name"], {"state": F.lit("open")}), scratch.folder(spark, "made"))


def cascade_set_default(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "region").filter("r_regionkey = 1")
    return K.on_delete(table(spark, folder, "nation"), ["n_regionkey"], gone, ["r_regionkey"], "set default", F.lit(-1))


def constraint_not_null(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, None).otherwise(F.col("o_totalprice")).alias("price"))
    return K.not_null_violations(rows, "price").select("o_orderkey")


def proc_params(spark: SparkSession, folder: str) -> DataFrame:
    """A procedure with two parameters in and two out."""
    register(spark, folder, ["orders"])
    return P.call(
        spark,
        "least DOUBLE, status STRING",
        (200000.0, "F"),
        "n BIGINT, top DOUBLE",
        "SET (n, top) = (SELECT count(*), max(o_totalprice) FROM orders WHERE o_totalprice > least AND o_orderstatus = status); IF n = 0 THEN SET top = -1; END IF;",
    )


def proc_for_select(spark: SparkSession, folder: str) -> DataFrame:
    """FOR SELECT with LEAVE: names are joined until one is reached."""
    register(spark, folder, ["region"])
    return P.script(
        spark,
        """
        BEGIN
          DECLARE names STRING DEFAULT '';
          DECLARE seen INT DEFAULT 0;
          walk: FOR r AS SELECT r_regionkey AS k, r_name AS name FROM region ORDER BY r_regionkey DO
            IF r.k >= 3 THEN LEAVE walk; END IF;
            SET names = concat(names, r.name, ';');
            SET seen = seen + 1;
          END FOR walk;
          SELECT names AS names, seen AS seen;
        END""",
    )


def proc_exit(spark: SparkSession, folder: str) -> DataFrame:
    """EXIT leaves the whole block, out of two loops."""
    return P.script(
        spark,
        """
        BEGIN
          DECLARE i INT DEFAULT 0;
          DECLARE j INT DEFAULT 0;
          body: BEGIN
            WHILE true DO
              SET i = i + 1;
              SET j = 0;
              WHILE j < 5 DO
                SET j = j + 1;
                IF i * j = 12 THEN LEAVE body; END IF;
              END WHILE;
            END WHILE;
          END body;
          SELECT i AS i, j AS j;
        END""",
    )


def select_into(spark: SparkSession, folder: str) -> DataFrame:
    """SELECT ... INTO variables, used by the next query."""
    register(spark, folder, ["customer"])
    return P.script(
        spark,
        """
        BEGIN
          DECLARE most DOUBLE;
          DECLARE n BIGINT;
          SET (most, n) = (SELECT max(c_acctbal), count(*) FROM customer);
          SELECT c_custkey, n AS customers FROM customer WHERE c_acctbal = most;
        END""",
    )


def execute_immediate(spark: SparkSession, folder: str) -> DataFrame:
    """EXECUTE STATEMENT: a query made as text, with parameters."""
    register(spark, folder, ["customer"])
    return spark.sql("EXECUTE IMMEDIATE 'SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > ? AND c_nationkey < ? GROUP BY c_mktsegment' USING 1000.0, 20")


QUERIES = {
    f.__name__: f
    for f in (
        view_columns, having_parameter, parameter_null, catalog_joined, dml_insert_written, external_csv, external_json, fetch_batches, cursor_fetch, pred_fallible, ddl_alter_table, ddl_create_table,
        cascade_set_default, constraint_not_null, proc_params, proc_for_select, proc_exit, select_into, execute_immediate,
    )
}
ORACLES = {
    "view_columns": "WITH r AS (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal AS bal FROM customer WHERE c_acctbal > 0), v AS (SELECT nation, count(*) AS n, max(bal) AS most FROM r WHERE bal > 4000 GROUP BY nation) SELECT r.k, v.n, v.most FROM r JOIN v ON r.nation = v.nation AND r.bal = v.most",
    "having_parameter": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 2 AND max(c_acctbal) > 5000",
    "parameter_null": "SELECT c_custkey, NULL::BOOLEAN AS gt, NULL::BOOLEAN AS le, CASE WHEN c_mktsegment = 'BUILDING' THEN true END AS listed, NULL::BOOLEAN AS matched, CASE WHEN c_custkey < 1 THEN false END AS ranged FROM customer",
    "catalog_joined": "SELECT table_name AS relation, count(*) AS fields, max(column_name) AS last_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events') AND column_name NOT LIKE '%comment%' GROUP BY table_name HAVING count(*) > 2",
    "dml_insert_written": "SELECT * FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region",
    "external_csv": "SELECT n_name, count(*) AS n, max(s_acctbal) AS top FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "external_json": "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part WHERE p_size > 10",
    "fetch_batches": "SELECT (place // 10)::INT AS batch, count(*)::INT AS n, arg_min(n_name, place) AS first_name, arg_max(n_name, place) AS last_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation) GROUP BY 1",
    "cursor_fetch": "SELECT r_name, sum(r_regionkey) OVER (ORDER BY r_regionkey)::BIGINT AS total FROM (SELECT * FROM region ORDER BY r_regionkey OFFSET 2)",
    "pred_fallible": "SELECT true AS reached, false AS guarded",
    "ddl_alter_table": "SELECT 'new' AS n_status, n_name AS n_title, CAST(n_regionkey AS DECIMAL(9,2)) AS n_regionkey, CAST(NULL AS VARCHAR) AS n_note FROM nation",
    "ddl_create_table": "SELECT r_regionkey::INT AS id, r_name AS name, 'open' AS state FROM region",
    "cascade_set_default": "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation",
    "constraint_not_null": "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000",
    "proc_params": "SELECT count(*) AS n, coalesce(max(o_totalprice), -1) AS top FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'",
    "proc_for_select": "SELECT string_agg(r_name || ';', '' ORDER BY r_regionkey) AS names, count(*)::INT AS seen FROM region WHERE r_regionkey < 3",
    "proc_exit": "SELECT 3 AS i, 4 AS j",
    "select_into": "SELECT c_custkey, (SELECT count(*) FROM customer) AS customers FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)",
    "execute_immediate": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 AND c_nationkey < 20 GROUP BY c_mktsegment",
}
