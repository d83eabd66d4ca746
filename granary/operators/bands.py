"""Self-joins on equal keys and a distance, without comparing all rows that share the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block (Spark holds all pairs of two blocks before it passes them on), pairs that a task compares, rows that a task sorts, most tasks.
BLOCK, TASK, SORT, TASKS = 128, 1 << 22, 1 << 16, 20_000


def band_of(value: Column, width: int) -> Column:
    """The band of a double, for values less than width apart; width is a power of two, so that the division is exact. NULL for what is at no finite distance from anything."""
    return F.when(value - value == 0, F.floor(F.greatest(F.least(value / width, F.lit(2.0**62)), F.lit(-(2.0**62)))))


def close_pairs(rows: DataFrame, equal: list[str], band: Column, key: str, names: tuple[str, str], value: str | None = None, within: float = 0) -> DataFrame:
    """Keys (lower, higher) of rows that agree in equal and whose bands, whole numbers, differ by one at most; with value, whose values differ by less than within.

    Rows of a band meet in blocks, so a cell with many rows is spread over tasks and no task holds it; the pairs are made from arrays and not from joined rows.
    A NULL makes no pair.
    """
    cell = [*equal, "_band"]
    rows = rows.select(*equal, band.cast("bigint").alias("_band"), F.col(key).alias("_key"), *([F.col(value).alias("_value")] if value else []))
    for name in rows.columns:
        rows = rows.filter(F.col(name).isNotNull())
    count, compared = rows.groupBy(*cell).count().agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count") * 1.5)).first()
    tasks, sorts = (int(min((x or 0) // most + 1, TASKS)) for x, most in ((compared, TASK), (count, SORT)))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("_key")) - 1
    row = F.struct("_key", "_value") if value else F.col("_key")
    blocks = rows.repartition(sorts, *cell).withColumn("_block", (number / BLOCK).cast("bigint")).groupBy(*cell, "_block").agg(F.collect_list(row).alias("_rows"))
    blocks = blocks.repartition(sorts, *cell)  # both sides read this exchange
    left = blocks.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_step")).withColumn("_band", F.col("_band") + F.col("_step"))
    right = blocks.withColumnsRenamed({"_block": "_block2", "_rows": "_rows2"})
    met = left.join(right, cell).filter("_step = 1 OR _block <= _block2").repartition(tasks, *cell, "_step", "_block", "_block2")
    pairs = met.select((F.expr("_step = 0 AND _block = _block2")).alias("_once"), "_rows2", F.explode("_rows").alias("_a")).select("_once", "_a", F.explode("_rows2").alias("_b"))
    a, b = (F.col(x)["_key"] if value else F.col(x) for x in ("_a", "_b"))
    wanted = (a < b) | (~F.col("_once") & (a > b))  # a block with itself has every pair both ways
    if value:
        wanted &= F.abs(F.col("_a")["_value"] - F.col("_b")["_value"]) < within
    return pairs.filter(wanted).select(F.least(a, b).alias(names[0]), F.greatest(a, b).alias(names[1]))
