"""Scalar functions, conditionals, dates and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import compat as C
from granary.plans.sqltext import both, pairs
from granary.sources.tables import table

S = "(VALUES (1, 'Hello'), (2, 'ababXab'), (3, NULL), (4, ''), (5, 'abbaX'), (6, 'x'), (7, 'données')) AS t(id, s)"
N = "(VALUES (1, 7, 2), (2, -7, 2), (3, 7, -2), (4, NULL, 3), (5, 0, 5)) AS t(id, a, b)"
D = "(VALUES (1, DATE '2024-01-31', TIMESTAMP '2024-01-31 10:59:59', TIMESTAMP '2024-03-01 11:00:01'), (2, DATE '2020-12-31', TIMESTAMP '2020-12-31 23:59:59.123', TIMESTAMP '2021-01-01 00:00:00'), (3, DATE '1999-02-28', TIMESTAMP '1999-02-28 00:00:00', TIMESTAMP '1998-05-05 05:05:05.5')) AS t(id, d, t1, t2)"
X = "(VALUES (1, CAST(2.5 AS DECIMAL(9,2))), (2, -2.5), (3, 12.55), (4, -12.55), (5, 0.49), (6, NULL)) AS t(id, x)"

SAME = {
    "fn_string": f"SELECT id, upper(s) AS u, lower(s) AS l, char_length(s) AS n, octet_length(CAST(s AS {{blob}})) AS o, reverse(s) AS r, replace(s, 'ab', '-') AS rep, concat(s, '!') AS c FROM {S}",
    "fn_left_right": f"SELECT id, left(s, 3) AS l, right(s, 2) AS r FROM {S}",
    "fn_pad": f"SELECT id, lpad(s, 8, 'xy') AS l, rpad(s, 8, 'xy') AS r, lpad(s, 2, '*') AS cut FROM {S}",
    "fn_math": f"SELECT id, a + b AS s, a - b AS d, a * b AS p, -a AS neg, abs(a) AS ab FROM {N}",
    "fn_case": f"SELECT id, CASE WHEN a > 0 THEN 'pos' WHEN a < 0 THEN 'neg' END AS searched, CASE a WHEN 7 THEN 'seven' WHEN NULL THEN 'none' ELSE 'other' END AS simple FROM {N}",
    "fn_coalesce": f"SELECT id, coalesce(a, b, 0) AS c, nullif(a, 7) AS n, coalesce(nullif(b, 2), -1) AS m FROM {N}",
    "cast_numeric": f"SELECT id, CAST(x AS DECIMAL(9,1)) AS d1 FROM {X}",
    "cast_double": f"SELECT id, CAST(x AS DOUBLE) AS dbl FROM {X}",
    "cast_dates": "SELECT CAST('2024-02-29' AS DATE) AS d, CAST('2024-02-29 12:34:56.5' AS TIMESTAMP) AS ts, CAST(TIMESTAMP '2024-02-29 12:34:56' AS DATE) AS cut",
}


def _rows(spark: SparkSession, relation: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {relation}")


def fn_substring(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s")
    cases = {"a": (0, 3), "b": (-2, 4), "c": (2, 2), "d": (4, 10), "e": (9, 2), "f": (1, 0)}
    return _rows(spark, S).select("id", *(C.substring(s, i, n).alias(k) for k, (i, n) in cases.items()), C.substring(s, 3).alias("open"))


def fn_trim(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s")
    return _rows(spark, S).select("id", C.trim(s, "ab").alias("ab"), C.trim(s, "ab", "leading").alias("lead"), C.trim(s, "ab", "trailing").alias("trail"), C.trim(s, "").alias("nothing"), C.trim(F.concat(F.lit("  "), s, F.lit(" "))).alias("blank"))


def fn_position(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s")
    return _rows(spark, S).select("id", C.position(F.lit("ab"), s).alias("p1"), C.position(F.lit("ab"), s, 2).alias("p2"), C.position(F.lit(""), s, 3).alias("e3"), C.position(F.lit(""), s, 6).alias("e6"))


def fn_int_division(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, N)
    return rows.select("id", C.int_div(F.col("a"), F.col("b")).cast("bigint").alias("q"), C.mod(F.col("a"), F.col("b")).alias("r"), C.sign(F.col("a")).alias("sg"))


def fn_mod(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, X).select("id", C.mod(F.col("x"), F.lit(5)).alias("m"), C.mod(F.col("x"), F.lit(2.4)).alias("m2"))


def fn_decimal_division(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, X).select("id", C.dec_div(F.col("x"), F.lit(3).cast("decimal(9,2)"), 2, 2).alias("q"))


def fn_decode(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("a")
    return _rows(spark, N).select("id", C.decode(a, F.lit(7), F.lit("seven"), F.lit(None).cast("int"), F.lit("null"), default=F.lit("other")).alias("d"), C.decode(a, F.lit(0), F.lit("zero")).alias("bare"), C.iif(a > 0, F.lit("y"), F.lit("n")).alias("i"))


def fn_extract(spark: SparkSession, folder: str) -> DataFrame:
    d, t = F.col("d"), F.col("t2")
    parts = {p: C.extract(p, d).cast("int").alias(p) for p in ("year", "month", "day", "weekday", "yearday", "week")}
    clock = {p: C.extract(p, t).cast("int").alias(p) for p in ("hour", "minute")}
    return _rows(spark, D).select("id", *parts.values(), *clock.values(), C.extract("second", t).cast("double").alias("second"), C.extract("millisecond", t).cast("double").alias("millisecond"))


def fn_extract_table(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("o_orderdate")
    return table(spark, folder, "orders").select("o_orderkey", *(C.extract(p, x).cast("int").alias(p) for p in ("year", "month", "weekday", "yearday", "week")))


def fn_dateadd(spark: SparkSession, folder: str) -> DataFrame:
    d, t = F.col("d"), F.col("t1")
    return _rows(spark, D).select(
        "id", C.date_add("month", 1, d).alias("m1"), C.date_add("year", 1, d).alias("y1"), C.date_add("day", -31, d).alias("d31"), C.date_add("week", 2, d).alias("w2"), C.date_add("hour", 50, d).alias("h50"),
        C.timestamp_add("month", 1, t).alias("tm"), C.timestamp_add("minute", 90, t).alias("t90"),
    )


def fn_datediff(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("t1"), F.col("t2")
    return _rows(spark, D).select("id", *(C.date_diff(u, a, b).alias(u) for u in ("year", "month", "day", "week", "hour", "minute", "second")), C.date_diff("millisecond", a, b).cast("double").alias("millisecond"))


def fn_date_arith(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, D).select("id", F.date_add("d", 7).alias("plus"), C.days_between(F.to_date("t2"), F.col("d")).cast("bigint").alias("days"), C.timestamp_days(F.col("t2"), F.col("t1")).cast("double").alias("span"))


def fn_time_wrap(spark: SparkSession, folder: str) -> DataFrame:
    ticks = spark.sql("SELECT * FROM (VALUES (1, 863999999L), (2, 0L), (3, 36000000L)) AS t(id, x)")
    return ticks.select("id", C.time_add("minute", 2, F.col("x")).alias("later"), C.time_add("hour", -1, F.col("x")).alias("earlier"))


def cast_int(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, X).select("id", C.to_int(F.col("x")).alias("i"), C.to_int(F.col("x"), "bigint").alias("b"))


def cast_text(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, S).select("id", C.varchar_text(F.col("s"), 7).alias("v"), C.char_text(F.substring("s", 1, 5), 8).alias("c"))


def cast_text_number(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM (VALUES (1, '1.999999'), (2, ' 42 '), (3, '-2.5'), (4, NULL), (5, '1e3'), (6, '0x1F'), (7, ' 0xFFFFFFFFFFFFFFFE')) AS t(id, s)")
    return rows.select("id", C.text_to_int(F.col("s")).alias("i"))


def cast_boolean(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM (VALUES (1, 'true'), (2, ' FALSE'), (3, NULL)) AS t(id, s)")
    return rows.select("id", C.text_bool(F.col("s")).alias("b"))


def cast_double_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM (VALUES (1, 0.5D), (2, 123.25D), (3, -7.0D), (4, 0.0D)) AS t(id, x)")
    return rows.select("id", C.double_text(F.col("x")).alias("t"))


def sql_function(spark: SparkSession, folder: str) -> DataFrame:
    """A stored function, as a SQL function that the planner inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION granary_discounted(price DOUBLE, cut DOUBLE) RETURNS DOUBLE RETURN price * (1 - cut)")
    table(spark, folder, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, round(granary_discounted(l_extendedprice, l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45")


_OURS = {k: v.replace("{blob}", "BINARY") for k, v in SAME.items()}
_THEIRS = {k: v.replace("{blob}", "BLOB") for k, v in SAME.items()}
QUERIES, ORACLES = pairs({k: (_OURS[k], _THEIRS[k]) for k in SAME})
QUERIES |= {
    f.__name__: f
    for f in (fn_substring, fn_trim, fn_position, fn_int_division, fn_mod, fn_decimal_division, fn_decode, fn_extract, fn_extract_table, fn_dateadd, fn_datediff, fn_date_arith, fn_time_wrap, cast_int, cast_text, cast_text_number, cast_boolean, cast_double_text, sql_function)
}
_WINDOW = lambda i, n: f"substring(s, {max(i, 1)}, {max(i + n - max(i, 1), 0)})"
_ROUND = "CAST(sign(x) * floor(abs(x) + 0.5) AS INT)"
ORACLES |= {
    "fn_string": _THEIRS["fn_string"].replace("octet_length(CAST(s AS BLOB))", "octet_length(encode(s))").replace("concat(s, '!')", "s || '!'"),
    "fn_substring": f"SELECT id, {_WINDOW(0, 3)} AS a, {_WINDOW(-2, 4)} AS b, {_WINDOW(2, 2)} AS c, {_WINDOW(4, 10)} AS d, {_WINDOW(9, 2)} AS e, {_WINDOW(1, 0)} AS f, substring(s, 3) AS open FROM {S}",
    "fn_trim": f"SELECT id, regexp_replace(regexp_replace(s, '^(ab)+', ''), '(ab)+$', '') AS ab, regexp_replace(s, '^(ab)+', '') AS lead, regexp_replace(s, '(ab)+$', '') AS trail, s AS nothing, trim('  ' || s || ' ') AS blank FROM {S}",
    "fn_position": f"SELECT id, position('ab' IN s)::INT AS p1, CASE WHEN position('ab' IN substring(s, 2)) > 0 THEN position('ab' IN substring(s, 2)) + 1 WHEN s IS NOT NULL THEN 0 END::INT AS p2, CASE WHEN 3 <= length(s) + 1 THEN 3 ELSE 0 END AS e3, CASE WHEN 6 <= length(s) + 1 THEN 6 ELSE 0 END AS e6 FROM {S}",
    "fn_int_division": f"SELECT id, (a // b)::BIGINT AS q, (a % b)::BIGINT AS r, sign(a)::SMALLINT AS sg FROM {N}",
    "fn_mod": f"SELECT id, ({_ROUND} % 5)::BIGINT AS m, ({_ROUND} % 2)::BIGINT AS m2 FROM {X}",
    "fn_decimal_division": f"SELECT id, CAST(sign(x) * ((abs(x) * 10000)::BIGINT // 3) / 10000 AS DECIMAL(38,4)) AS q FROM {X}",
    "fn_decode": f"SELECT id, CASE WHEN a = 7 THEN 'seven' ELSE 'other' END AS d, CASE WHEN a = 0 THEN 'zero' END AS bare, CASE WHEN a > 0 THEN 'y' ELSE 'n' END AS i FROM {N}",
    "fn_extract": f"SELECT id, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, dayofweek(d)::INT AS weekday, (dayofyear(d) - 1)::INT AS yearday, week(d)::INT AS week, hour(t2)::INT AS hour, minute(t2)::INT AS minute, (epoch_us(t2) % 60000000 / 1000000.0)::DOUBLE AS second, (epoch_us(t2) % 1000000 / 1000.0)::DOUBLE AS millisecond FROM {D}",
    "fn_extract_table": "SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, dayofweek(o_orderdate)::INT AS weekday, (dayofyear(o_orderdate) - 1)::INT AS yearday, week(o_orderdate)::INT AS week FROM orders",
    "fn_dateadd": f"SELECT id, CAST(d + INTERVAL 1 MONTH AS DATE) AS m1, CAST(d + INTERVAL 1 YEAR AS DATE) AS y1, d - 31 AS d31, d + 14 AS w2, d + 2 AS h50, t1 + INTERVAL 1 MONTH AS tm, t1 + INTERVAL 90 MINUTE AS t90 FROM {D}",
    "fn_datediff": f"SELECT id, date_diff('year', t1, t2) AS year, date_diff('month', t1, t2) AS month, date_diff('day', t1, t2) AS day, CAST(trunc(date_diff('day', t1, t2) / 7) AS BIGINT) AS week, date_diff('hour', t1, t2) AS hour, date_diff('minute', t1, t2) AS minute, date_diff('second', t1, t2) AS second, (epoch_us(t2) // 100 - epoch_us(t1) // 100) / 10.0 AS millisecond FROM {D}",
    "fn_date_arith": f"SELECT id, d + 7 AS plus, CAST(t2 AS DATE) - d AS days, (epoch_us(t2) - epoch_us(t1)) / 86400000000.0 AS span FROM {D}",
    "fn_time_wrap": "SELECT id, (x + 1200000) % 864000000 AS later, (x - 36000000 + 864000000) % 864000000 AS earlier FROM (VALUES (1, 863999999::BIGINT), (2, 0::BIGINT), (3, 36000000::BIGINT)) AS t(id, x)",
    "cast_int": f"SELECT id, {_ROUND} AS i, {_ROUND}::BIGINT AS b FROM {X}",
    "cast_text": f"SELECT id, substring(s, 1, 7) AS v, rpad(substring(s, 1, 5), 8, ' ') AS c FROM {S}",
    "cast_text_number": "SELECT id, CAST(sign(x) * floor(abs(x) + 0.5) AS INT) AS i FROM (SELECT id, CAST(trim(s) AS DOUBLE) AS x FROM (VALUES (1, '1.999999'), (2, ' 42 '), (3, '-2.5'), (4, NULL), (5, '1e3'), (6, '31'), (7, '-2')) AS t(id, s))",
    "cast_boolean": "SELECT id, CAST(lower(trim(s)) AS BOOLEAN) AS b FROM (VALUES (1, 'true'), (2, ' FALSE'), (3, NULL)) AS t(id, s)",
    "cast_double_text": "SELECT * FROM (VALUES (1, '0.5000000000000000'), (2, '123.2500000000000'), (3, '-7.000000000000000'), (4, '0.000000000000000')) AS t(id, t)",
    "sql_function": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45",
}
