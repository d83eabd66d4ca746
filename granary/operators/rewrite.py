"""Relational forms that Spark's parser or planner does not take, as equivalent plans."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from granary.operators.constraints import with_sequence


def first_skip(df: DataFrame, first: int | None = None, skip: int = 0) -> DataFrame:
    """FIRST n SKIP m of an ordered frame."""
    df = df.offset(skip) if skip else df
    return df if first is None else df.limit(first)


def rows_to(df: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """ROWS n, or ROWS n TO m (from 1, both ends included)."""
    return df.limit(low) if high is None else df.offset(low - 1).limit(max(high - low + 1, 0))


_SWAP = {"=": "eq", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[_SWAP[op]]


def compare_any(df: DataFrame, x: Column, op: str, values: DataFrame, column: str, name: str = "matches") -> DataFrame:
    """df with x op ANY (values): true if it holds for one, else unknown if it is unknown for one, else false.

    Order comparisons and = need four numbers of the values; = also needs membership, as a semi-join would. One row of
    aggregates is joined, so df is not shuffled, except for =.
    """
    v = F.col(column)
    facts = values.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(v).alias("_k"))
    joined = df.withColumn("_x", x).crossJoin(F.broadcast(facts))  # one row
    unknown = (F.col("_n") > 0) & (F.col("_x").isNull() | (F.col("_n") > F.col("_k")))
    if op == "=":
        distinct = values.select(v.alias("_v")).distinct().withColumn("_hit", F.lit(True))
        joined = joined.join(distinct, F.col("_x") == F.col("_v"), "left")
        true = F.coalesce(F.col("_hit"), F.lit(False))
    elif op == "<>":
        true = F.coalesce((F.col("_k") > 0) & ((F.col("_lo") != F.col("_x")) | (F.col("_hi") != F.col("_x"))), F.lit(False))
    else:
        true = F.coalesce(_compare(op, F.col("_x"), F.col("_hi") if op in ("<", "<=") else F.col("_lo")), F.lit(False))
    result = F.when(true, True).when(unknown, F.lit(None)).otherwise(False)
    return joined.withColumn(name, result).drop("_x", "_lo", "_hi", "_n", "_k", "_v", "_hit")


def compare_all(df: DataFrame, x: Column, op: str, values: DataFrame, column: str, name: str = "matches") -> DataFrame:
    """df with x op ALL (values): the negation of the opposite ANY; true over no values."""
    opposite = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}[op]
    return compare_any(df, x, opposite, values, column, name).withColumn(name, ~F.col(name))


def singular(df: DataFrame, keys: list[str], inner: DataFrame, inner_keys: list[str]) -> DataFrame:
    """Rows of df for which exactly one row of inner has equal keys."""
    once = inner.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(inner_keys))).agg(F.count("*").alias("_n")).filter("_n = 1")
    condition = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return df.join(once, condition, "left_semi")


def count_distinct_over(x: Column, window: WindowSpec) -> Column:
    """COUNT(DISTINCT x) OVER a window with a frame. For whole partitions count_distinct_partition() is the one that scales."""
    return F.size(F.collect_set(x).over(window)).cast("bigint")


def count_distinct_partition(df: DataFrame, keys: list[str], x: Column, name: str) -> DataFrame:
    """df with COUNT(DISTINCT x) OVER (PARTITION BY keys): counted once for each key and joined back, so no partition is held in one task."""
    counts = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.countDistinct(x).alias(name))
    condition = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(counts, condition).drop(*(f"_k{i}" for i in range(len(keys))))


def distribution_over(df: DataFrame, order: list[str], tiles: int) -> DataFrame:
    """df with NTILE(tiles), PERCENT_RANK and CUME_DIST over all rows in a total order: columns tile, percent, cume.

    Rows are numbered by sorted ranges, so no task holds all of them.
    """
    numbered = with_sequence(df, "_rn", order)
    whole = df.agg(F.count("*").alias("_all"))
    joined = numbered.crossJoin(F.broadcast(whole))  # one row
    size, more = F.call_function("div", F.col("_all"), F.lit(tiles)), F.col("_all") % tiles
    longer = more * (size + 1)
    tile = F.when(F.col("_rn") <= longer, F.call_function("div", F.col("_rn") - 1, size + 1) + 1).otherwise(more + F.call_function("div", F.col("_rn") - longer - 1, F.greatest(size, F.lit(1))) + 1)
    percent = F.when(F.col("_all") > 1, (F.col("_rn") - 1) / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    return joined.select(*df.columns, tile.cast("int").alias("tile"), percent.alias("percent"), (F.col("_rn") / F.col("_all")).alias("cume"))


def raised(df: DataFrame) -> DataFrame:
    """One row, raised: whether working df out raises."""
    spark = df.sparkSession
    try:
        df.write.format("noop").mode("overwrite").save()
    except PySparkException:
        return spark.range(1).select(F.lit(True).alias("raised"))
    return spark.range(1).select(F.lit(False).alias("raised"))


def filtered_over(aggregate, x: Column, condition: Column, window: WindowSpec) -> Column:
    """aggregate(x) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, x)).over(window)


def text_key_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join on text keys without regard to trailing blanks."""
    return left.join(right, F.rtrim(F.col(left_key)) == F.rtrim(F.col(right_key)), how)
