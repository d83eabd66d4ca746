"""The rules of functions/compat.py over whole tables: exact and wide numbers, texts, time, charsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import compat as C
from granary.functions import decfloat as X
from granary.operators import rewrite as R
from granary.plans.sqltext import both
from granary.sources.tables import table

SAME = {
    "case_branch_scale": "SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS DECIMAL(9,1)) ELSE CAST(p_partkey AS DECIMAL(12,3)) END AS c, coalesce(CAST(nullif(p_size, 3) AS DECIMAL(5,2)), CAST(0.125 AS DECIMAL(4,3))) AS k FROM part",
    "join_key_boolean": "SELECT n_name, f.label FROM nation JOIN (VALUES (true, 'high'), (false, 'low'), (CAST(NULL AS BOOLEAN), 'none')) AS f(flag, label) ON (n_regionkey > 2) = f.flag",
    "join_key_decimal": "SELECT o_orderkey, c_name FROM orders JOIN customer ON CAST(o_custkey AS DECIMAL(38,8)) = CAST(c_custkey AS DECIMAL(20,0))",
    "agg_percentile": "SELECT c_nationkey, round({pct}, 6) AS median, round(regr_slope(c_acctbal, c_custkey), 9) AS slope, round(regr_intercept(c_acctbal, c_custkey), 6) AS origin, regr_count(c_acctbal, c_custkey) AS n FROM customer GROUP BY c_nationkey",
    "agg_approximate": "SELECT o_orderstatus, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.15 * count(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus",
    "win_range_desc": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END DESC {last} RANGE BETWEEN 500 PRECEDING AND 100 FOLLOWING) AS near FROM orders",
    "order_default_nulls": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 150000 THEN o_totalprice END {low_up}, o_orderkey) AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 150000 THEN o_totalprice END DESC {low_down}, o_orderkey) AS down FROM orders",
    "order_collated_table": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {fold}, c_custkey) AS place FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS seg FROM customer) x",
}
OURS = {"{pct}": "percentile(c_acctbal, 0.5)", "{last}": "", "{low_up}": "", "{low_down}": "", "{fold}": "seg COLLATE UNICODE_CI"}
THEIRS = {"{pct}": "quantile_cont(c_acctbal, 0.5)", "{last}": "NULLS LAST", "{low_up}": "NULLS FIRST", "{low_down}": "NULLS LAST", "{fold}": "lower(seg)"}


def _filled(text: str, parts: dict[str, str]) -> str:
    for name, value in parts.items():
        text = text.replace(name, value)
    return text


def join_key_zone(spark: SparkSession, folder: str) -> DataFrame:
    """Instants written with different offsets meet as keys."""
    return spark.sql("SELECT a.id AS x, b.id AS y FROM (VALUES (1, TIMESTAMP '2024-01-01 10:00:00+02:00'), (2, TIMESTAMP '2024-01-01 10:00:00Z')) AS a(id, t) JOIN (VALUES (1, TIMESTAMP '2024-01-01 08:00:00Z'), (2, TIMESTAMP '2024-01-01 05:00:00-05:00')) AS b(id, t) ON a.t = b.t")


def fn_decimal_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(9,2)").alias("q"), (F.col("l_linenumber") + F.lit(2)).cast("decimal(9,1)").alias("k"))
    q, k = F.col("q"), F.col("k")
    return rows.select("l_orderkey", "l_linenumber", C.dec_mul(q, k, 2, 1).alias("product"), C.dec_div(q, k, 2, 1).alias("quotient"), (q + k).cast("decimal(18,2)").alias("total"))


def fn_wide_integer(spark: SparkSession, folder: str) -> DataFrame:
    """Products, sums and differences beyond 64 bits."""
    x = F.col("o_orderkey") + F.lit(4_000_000_000_000_000_000)
    rows = table(spark, folder, "orders").select("o_orderkey", C.wide(x).alias("x"), C.wide(F.col("o_custkey") + F.lit(3_000_000_000)).alias("y"))
    whole = "decimal(38,0)"
    return rows.select("o_orderkey", (F.col("x") * F.col("y")).cast(whole).alias("product"), (F.col("x") + F.col("x") + F.col("x")).cast(whole).alias("total"), (-F.col("x") - F.col("x") - F.col("y")).cast(whole).alias("below"))


def fn_approximate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(C.finite(F.col("l_extendedprice") * F.lit(1.05e0) / (F.lit(1e0) - F.col("l_discount"))), 4).alias("gross"), F.round(F.col("l_quantity") * F.lit(1e-2) + F.lit(2.5e1), 6).alias("scaled"))


DECFLOATS = (
    ("add", "1.10", "2.2", "3.30"), ("add", "1E+20", "1E-20", "100000000000000000000.0000000000000"), ("subtract", "1.00", "1", "0.00"), ("multiply", "1.20", "3", "3.60"), ("divide", "1", "3", "0.3333333333333333333333333333333333"),
    ("divide", "2", "3", "0.6666666666666666666666666666666667"), ("divide", "10", "4", "2.5"), ("round", "2.345", "2", "2.35"), ("round", "-2.5", "0", "-3"), ("multiply", "9.9E+3000", "2", "1.98E+3001"), ("add", None, "1", None),
)


def fn_decfloat(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(DECFLOATS)], "id int, op string, a string, b string")
    out = None
    for op in (X.ADD, X.SUBTRACT, X.MULTIPLY, X.DIVIDE, X.ROUND):
        part = rows.filter(F.col("op") == op).select("id", X.decfloat(op, F.col("a"), F.col("b")).alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


def fn_decfloat_table(spark: SparkSession, folder: str) -> DataFrame:
    """Sums and comparisons of whole columns, read back as decimals."""
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("a"))
    return rows.select("c_custkey", X.decfloat(X.ADD, F.col("a"), F.lit("0.005")).cast("decimal(18,3)").alias("added"), X.decfloat(X.MULTIPLY, F.col("a"), F.lit("1.10")).cast("decimal(18,4)").alias("times"), X.decfloat(X.COMPARE, F.col("a"), F.lit("1000.000")).alias("compared"))


def pred_text_column(spark: SparkSession, folder: str) -> DataFrame:
    """A text column against a number: each row's text is read as a number."""
    rows = table(spark, folder, "customer").select("c_custkey", F.substring_index("c_name", "#", -1).alias("digits"))
    value = C.text_number(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "digits", F.lit("e1 "))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("0x"), "digits")).otherwise(F.concat("digits", F.lit(".5"))))
    return rows.select("c_custkey", value.cast("double").alias("value")).filter(F.col("value") >= 20)


def fn_text_table(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("p_name")
    return table(spark, folder, "part").select(
        "p_partkey", C.substring(s, 0, 4).alias("sub"), C.substring(s, 3).alias("open"), C.trim(s, "a").alias("trimmed"), C.position(F.lit("e"), s, 3).alias("at"), C.similar_to(s, "%[aeiou]{2}%").alias("vowels"),
        C.varchar_text(F.substring(s, 1, 6), 6).alias("v"), C.char_text(F.substring(s, 1, 3), 5).alias("c"), C.iif(C.starting(s, "a"), F.lit("yes"), F.lit("no")).alias("a"), C.decode(F.col("p_size") % 3, F.lit(0), F.lit("none"), F.lit(1), F.lit("one")).alias("d"),
    )


def fn_number_table(spark: SparkSession, folder: str) -> DataFrame:
    k, q = F.col("l_linenumber"), F.col("l_quantity").cast("decimal(9,2)")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", C.int_div(F.col("l_orderkey"), k + 1).cast("bigint").alias("quotient"), C.mod(-F.col("l_orderkey"), k + 1).alias("rest"), C.sign(k - 3).alias("sg"), C.to_int(q / F.lit(2)).alias("half"), C.truncate(q / F.lit(4), 1).alias("cut"))


def fn_blob(spark: SparkSession, folder: str) -> DataFrame:
    """Binary content: its length, segments, and the text that it holds."""
    b = F.col("b")
    rows = table(spark, folder, "part").select("p_partkey", F.col("p_name").cast("binary").alias("b"))
    return rows.select("p_partkey", F.octet_length(b).alias("n"), F.hex(F.substring(b, 1, 4)).alias("first_segment"), F.hex(F.substring(b, 5, 4)).alias("second_segment"), F.concat(F.substring(b, 1, 4), F.substring(b, 5, 1000)).cast("string").alias("whole"))


def fn_charset(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s")
    rows = table(spark, folder, "nation").select("n_nationkey", F.concat("n_name", F.lit("é§ü")).alias("s"))
    return rows.select("n_nationkey", F.octet_length(C.transliterate(s, "UTF-8")).alias("wide"), F.octet_length(C.transliterate(s, "ISO-8859-1")).alias("narrow"), C.from_charset(C.transliterate(s, "ISO-8859-1"), "ISO-8859-1").alias("back"))


def cast_texts_table(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("c_acctbal")
    return table(spark, folder, "customer").select("c_custkey", C.double_text(F.abs(x) / 7 + 1).alias("t"), C.double_text(x * 1e-9).alias("tiny"), C.float_text((F.col("c_custkey") / 8 + 1).cast("float")).alias("f"), C.bool_text(x > 0).alias("b"), C.text_bool(C.bool_text(x > 0)).alias("back"))


def cast_double_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Just below a power of ten, and exponents on either side of what is written out."""
    rows = spark.createDataFrame([(1, 999.9999999999999), (2, 1e15), (3, 1e16), (4, 1.5e-4), (5, 1.5e-5), (6, 0.0), (7, -123456.789), (8, None)], "id int, x double")
    return rows.select("id", C.double_text(F.col("x")).alias("t"))


def fn_time_table(spark: SparkSession, folder: str) -> DataFrame:
    t = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 1_234_567)
    rows = table(spark, folder, "orders").select("o_orderkey", t.alias("t"), F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 8).cast("decimal(9,2)").alias("k"))
    t, d, k = F.col("t"), F.col("d"), F.col("k") / F.lit(4)
    tick = C.time_of_day(t)
    return rows.select(
        "o_orderkey", C.date_plus(d, k).alias("days"), F.unix_micros(C.timestamp_plus(t, k)).alias("moved"), C.time_minus(tick, F.lit(36_000_000)).cast("double").alias("seconds"), C.date_diff("millisecond", d.cast("timestamp"), t).cast("double").alias("ms"),
        C.date_diff("hour", d.cast("timestamp"), t).alias("hours"), C.date_add("month", 1, d).alias("next_month"), C.date_diff("month", d, F.to_date(t)).alias("months"),
    )


def fn_now(spark: SparkSession, folder: str) -> DataFrame:
    """The clock is read once for a statement, whatever the number of rows."""
    now, today = F.localtimestamp(), F.current_date()
    rows = table(spark, folder, "lineitem").select(now.alias("t"), today.alias("d"), C.time_of_day(now).alias("c"))
    return rows.agg(F.countDistinct("t").alias("stamps"), F.countDistinct("d").alias("dates"), F.countDistinct("c").alias("clocks"), F.bool_and(F.to_date("t") == F.col("d")).alias("agree"))


def fn_zone(spark: SparkSession, folder: str) -> DataFrame:
    """Clocks of zones with and without a change of time."""
    t = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, folder, "orders").select("o_orderkey", C.at_zone(t, "+05:30").alias("east"), C.from_zone(t, "-03:00").alias("west"), C.at_zone(t, "America/New_York").alias("york"))
    return rows.select("o_orderkey", *(F.unix_micros(c).alias(c) for c in ("east", "west")), F.floor(F.unix_micros("york") / F.lit(3_600_000_000)).alias("york_hours"))


def win_distribution(spark: SparkSession, folder: str) -> DataFrame:
    found = R.distribution_over(table(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], 4)
    return found.select("s_suppkey", F.col("tile").alias("quarter"), F.round("percent", 9).alias("pr"), F.round("cume", 9).alias("cd"))


_RULES = {k: _filled(v, OURS) for k, v in SAME.items()}
QUERIES, _ = both(_RULES)
ORACLES = {k: _filled(v, THEIRS) for k, v in SAME.items()}
QUERIES |= {
    f.__name__: f
    for f in (
        join_key_zone, fn_decimal_table, fn_wide_integer, fn_approximate, fn_decfloat, fn_decfloat_table, pred_text_column, fn_text_table, fn_number_table, fn_blob, fn_charset, cast_texts_table, cast_double_edges,
        fn_time_table, fn_now, fn_zone, win_distribution,
    )
}
_X = "(o_orderkey::HUGEINT + 4000000000000000000)"
_T = "(epoch_us(o_orderdate) + o_orderkey * 1234567)"
_HALF = "CAST(floor(x + 0.5) AS INT)"
ORACLES |= {
    "join_key_zone": "SELECT 1 AS x, 1 AS y UNION ALL SELECT 2, 2",
    "fn_decimal_table": "SELECT l_orderkey, l_linenumber, CAST(q * k / 1000.0 AS DECIMAL(38,3)) AS product, CAST((q * 10 * 10) // k / 1000.0 AS DECIMAL(38,3)) AS quotient, CAST((q + k * 10) / 100.0 AS DECIMAL(18,2)) AS total FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(9,2)) * 100 AS BIGINT) AS q, (l_linenumber::BIGINT + 2) * 10 AS k FROM lineitem)",
    "fn_wide_integer": f"SELECT o_orderkey, CAST({_X} * (o_custkey::HUGEINT + 3000000000) AS DECIMAL(38,0)) AS product, CAST({_X} * 3 AS DECIMAL(38,0)) AS total, CAST(-2 * {_X} - (o_custkey::HUGEINT + 3000000000) AS DECIMAL(38,0)) AS below FROM orders",
    "fn_approximate": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 1.05e0 / (1e0 - l_discount), 4) AS gross, round(l_quantity * 1e-2 + 2.5e1, 6) AS scaled FROM lineitem",
    "fn_decfloat": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if x[3] is None else repr(x[3])})" for i, x in enumerate(DECFLOATS)) + ") AS t(id, result)",
    "fn_decfloat_table": "SELECT c_custkey, CAST(a + 0.005 AS DECIMAL(18,3)) AS added, CAST(a * 1.10 AS DECIMAL(18,4)) AS times, CASE WHEN a < 1000 THEN -1 WHEN a = 1000 THEN 0 ELSE 1 END AS compared FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS a FROM customer)",
    "pred_text_column": "SELECT c_custkey, value FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN split_part(c_name, '#', 2)::BIGINT * 10.0 WHEN 1 THEN ('0x' || split_part(c_name, '#', 2))::BIGINT ELSE split_part(c_name, '#', 2)::BIGINT + 0.5 END::DOUBLE AS value FROM customer) WHERE value >= 20",
    "fn_text_table": "SELECT p_partkey, substring(p_name, 1, 3) AS sub, substring(p_name, 3) AS open, trim(p_name, 'a') AS trimmed, CASE WHEN position('e' IN substring(p_name, 3)) > 0 THEN position('e' IN substring(p_name, 3)) + 2 ELSE 0 END::INT AS at, regexp_matches(p_name, '[aeiou]{2}') AS vowels, substring(p_name, 1, 6) AS v, rpad(substring(p_name, 1, 3), 5, ' ') AS c, CASE WHEN starts_with(p_name, 'a') THEN 'yes' ELSE 'no' END AS a, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'one' END AS d FROM part",
    "fn_number_table": "SELECT l_orderkey, l_linenumber, l_orderkey // (l_linenumber + 1) AS quotient, -(l_orderkey % (l_linenumber + 1)) AS rest, sign(l_linenumber - 3)::SMALLINT AS sg, ((q + 100) // 200)::INT AS half, CAST(q // 40 / 10.0 AS DECIMAL(38,1)) AS cut FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(CAST(l_quantity AS DECIMAL(9,2)) * 100 AS BIGINT) AS q FROM lineitem)",
    "fn_blob": "SELECT p_partkey, octet_length(encode(p_name))::INT AS n, hex(p_name[1:4]) AS first_segment, hex(p_name[5:8]) AS second_segment, p_name AS whole FROM part",
    "fn_charset": "SELECT n_nationkey, (octet_length(encode(n_name)) + 6)::INT AS wide, (length(n_name) + 3)::INT AS narrow, n_name || 'é§ü' AS back FROM nation",
    "cast_texts_table": "SELECT c_custkey, format('{:#.16g}', abs(c_acctbal) / 7 + 1) AS t, format('{:#.16g}', c_acctbal * 1e-9) AS tiny, format('{:#.8g}', c_custkey / 8 + 1) AS f, CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS b, c_acctbal > 0 AS back FROM customer",
    "cast_double_edges": "SELECT * FROM (VALUES (1, '999.9999999999999'), (2, '1000000000000000.'), (3, '1.000000000000000e+16'), (4, '0.0001500000000000000'), (5, '1.500000000000000e-05'), (6, '0.000000000000000'), (7, '-123456.7890000000'), (8, NULL)) AS t(id, t)",
    "fn_time_table": f"SELECT o_orderkey, CAST(o_orderdate AS DATE) + {_HALF} AS days, {_T} + CAST(x * 86400000000 AS BIGINT) AS moved, ({_T} % 86400000000 // 100 - 36000000) / 10000.0 AS seconds, ({_T} // 100 - epoch_us(o_orderdate) // 100) / 10.0 AS ms, ({_T} // 3600000000 - epoch_us(o_orderdate) // 3600000000)::BIGINT AS hours, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, date_diff('month', o_orderdate, make_timestamp({_T})) AS months FROM (SELECT *, (o_orderkey % 8) / 4.0 AS x FROM orders)",
    "fn_now": "SELECT 1::BIGINT AS stamps, 1::BIGINT AS dates, 1::BIGINT AS clocks, true AS agree",
    "fn_zone": "SELECT o_orderkey, epoch_us(o_orderdate) + 19800000000 AS east, epoch_us(o_orderdate) + 10800000000 AS west, CAST(epoch_us(timezone('America/New_York', timezone('UTC', o_orderdate))) // 3600000000 AS BIGINT) AS york_hours FROM orders",
    "win_distribution": "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey)::INT AS quarter, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS pr, round(cume_dist() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS cd FROM supplier",
}
