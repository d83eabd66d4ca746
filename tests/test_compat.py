"""Rules that raise, and those whose answers differ from Spark's own."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.functions import compat as C
from granary.operators import constraints as K
from granary.operators import dml as D
from granary.operators import rewrite as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: C.substring(F.lit("abc"), 1, -1),
        lambda: C.varchar_text(F.lit("abcdef"), 3),
        lambda: C.text_bool(F.lit("t")),
        lambda: C.text_to_int(F.lit("x")),
        lambda: C.int_div(F.lit(1), F.lit(0)),
        lambda: C.finite(F.lit(1e200) * F.lit(1e200)),
        lambda: C.to_int(F.lit(3e9)),
        lambda: F.lit(2147483647) + F.lit(1),
    ],
)
def test_raises(spark, make):
    with pytest.raises(PySparkException):
        one(spark, make())


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: C.int_div(F.lit(-7), F.lit(2)), -3),
        (lambda: C.to_int(F.lit(2.5)), 3),
        (lambda: C.to_int(F.lit(-2.5)), -3),
        (lambda: C.substring(F.lit("Hello"), 0, 3), "He"),
        (lambda: C.substring(F.lit("Hello"), -2, 4), "H"),
        (lambda: C.trim(F.lit("abbaX"), "ab"), "baX"),
        (lambda: C.position(F.lit(""), F.lit("abc"), 3), 3),
        (lambda: C.position(F.lit(""), F.lit("abc"), 9), 0),
        (lambda: C.char_text(F.lit("ab"), 5), "ab   "),
        (lambda: C.varchar_text(F.lit("ab   "), 3), "ab "),
        (lambda: C.date_diff("minute", F.lit("2024-01-01 10:59:59").cast("timestamp"), F.lit("2024-01-01 11:00:01").cast("timestamp")), 1),
        (lambda: C.date_diff("month", F.lit("2024-01-31").cast("date"), F.lit("2024-03-01").cast("date")), 2),
        (lambda: C.decode(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("n"), default=F.lit("d")), "d"),
        (lambda: C.similar_to(F.lit("ab\n"), "ab"), False),
        (lambda: C.similar_to(F.lit("a%b"), "a#%b", "#"), True),
        (lambda: C.similar_to(F.lit("a.b"), "a.b"), True),
        (lambda: C.similar_to(F.lit("axb"), "a.b"), False),
        (lambda: C.similar_to(F.lit("ab12"), "[[:ALPHA:]]+[0-9]{2}"), True),
    ],
)
def test_answers(spark, column, want):
    assert one(spark, column()) == want


def test_merge_raises_where_a_row_meets_two(spark):
    t, s = spark.sql("SELECT 1 AS id, 'a' AS v"), spark.sql("SELECT * FROM (VALUES (1, 'x'), (1, 'y')) AS s(id, v)")
    merged = D.merge(t, s, lambda a, b: a("id") == b("id"), lambda a, b: [D.Branch(True, "update", {"v": b("v")})])
    with pytest.raises(PySparkException):
        merged.collect()


def test_merge_ignores_rows_without_action(spark):
    t, s = spark.sql("SELECT 1 AS id, 'a' AS v"), spark.sql("SELECT * FROM (VALUES (1, 'x'), (1, 'y')) AS s(id, v)")
    merged = D.merge(t, s, lambda a, b: a("id") == b("id"), lambda a, b: [D.Branch(True, "update", {"v": b("v")}, b("v") == "y")])
    assert [tuple(r) for r in merged.collect()] == [(1, "y")]


def test_upsert_treats_null_keys_as_equal(spark):
    t, s = spark.sql("SELECT CAST(NULL AS INT) AS k, 1 AS v"), spark.sql("SELECT CAST(NULL AS INT) AS k, 2 AS v")
    assert [tuple(r) for r in D.upsert(t, s, ["k"]).collect()] == [(None, 2)]


def test_any_all_over_nulls(spark):
    t = spark.sql("SELECT 5 AS a")
    v = spark.sql("SELECT * FROM (VALUES (1), (NULL)) AS v(x)")
    assert R.compare_any(t, F.col("a"), ">", v, "x").first()["matches"] is True
    assert R.compare_any(t, F.col("a"), "<", v, "x").first()["matches"] is None
    assert R.compare_all(t, F.col("a"), ">", v, "x").first()["matches"] is None
    assert R.compare_all(t, F.col("a"), "<", v, "x").first()["matches"] is False


def test_sequence_has_no_gaps(spark):
    rows = K.with_sequence(spark.range(1000).repartition(7), "n", ["id"]).collect()
    assert sorted((r["id"], r["n"]) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_pushdown_reaches_the_scan(spark, folder):
    from granary.sources.tables import table

    plan = table(spark, folder, "lineitem").filter("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_tax" not in plan
