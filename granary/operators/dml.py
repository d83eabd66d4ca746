"""INSERT, UPDATE, DELETE, upsert and MERGE as frames: each gives the table that results.

Tables are immutable files, so a statement is a plan from the old table to the new one; write it to a
new place and swap. RETURNING is the frame of affected rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def insert(target: DataFrame, source: DataFrame, columns: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... SELECT: source's columns go to columns by place, others get their default or null."""
    return target.unionByName(inserted(target, source, columns, defaults))


def inserted(target: DataFrame, source: DataFrame, columns: list[str] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The rows that insert() adds."""
    columns = columns or target.columns
    named = source.toDF(*columns)
    given = defaults or {}
    return named.select(*(named[c].cast(target.schema[c].dataType).alias(c) if c in columns else given.get(c, F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns))


def update(target: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """UPDATE: assignments all see the old row; rows for which condition is unknown stay."""
    hit = _true(condition)
    return target.select(*(F.when(hit, assignments[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in assignments else F.col(c) for c in target.columns))


def updated(target: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """UPDATE ... RETURNING: the new rows of those affected."""
    return update(target.filter(condition), F.lit(True), assignments)


def delete(target: DataFrame, condition: Column) -> DataFrame:
    """DELETE: rows for which condition is unknown stay."""
    return target.filter(~_true(condition))


def deleted(target: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... RETURNING: the old rows of those affected."""
    return target.filter(condition)


def upsert(target: DataFrame, source: DataFrame, matching: list[str]) -> DataFrame:
    """UPDATE OR INSERT ... MATCHING: source rows (of target's columns) replace rows of equal keys, nulls being equal.

    Rows of a frame have no order, so it is not defined which of two source rows of one key comes last: they raise.
    """
    rest = [c for c in target.columns if c not in matching]
    per = source.groupBy(*matching).agg(F.count("*").alias("_n"), F.first(F.struct(*(F.col(c) for c in [*rest, matching[0]]))).alias("_x"))
    several = F.raise_error(F.lit("several source rows of one key")).cast("boolean")
    once = per.filter(F.when(F.col("_n") > 1, several).otherwise(F.lit(True)))
    new = once.select(*(F.col(c) if c in matching else F.col(f"_x.{c}") for c in target.columns))
    keys = [target[c].eqNullSafe(F.col(f"_s_{c}")) for c in matching]
    return target.join(once.select(*(F.col(c).alias(f"_s_{c}") for c in matching)), keys, "left_anti").unionByName(new)


@dataclass
class Branch:
    """WHEN [NOT] MATCHED [AND condition] THEN action. action: 'update', 'delete' or 'insert'; values by column."""

    matched: bool
    action: str
    values: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, on: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], branches: Callable[[Callable[[str], Column], Callable[[str], Column]], list[Branch]]) -> DataFrame:
    """MERGE: the first branch whose condition holds acts on each joined row.

    on and branches get two functions that give columns of target and of source. A target row that meets more
    than one source row with an action raises.
    """
    t = target.withColumn("_row", F.monotonically_increasing_id()).select(*(F.col(c).alias(f"_t_{c}") for c in [*target.columns, "_row"]))
    s = source.select(*(F.col(c).alias(f"_s_{c}") for c in source.columns), F.lit(True).alias("_s__here"))
    of_t, of_s = (lambda c: F.col(f"_t_{c}")), (lambda c: F.col(f"_s_{c}"))
    rules = branches(of_t, of_s)
    joined = t.join(s, on(of_t, of_s), "full_outer")
    here, there = of_t("_row").isNotNull(), F.col("_s__here").isNotNull()
    choice = F.lit(-1)
    for i in range(len(rules) - 1, -1, -1):
        rule = rules[i]
        applies = (here & there) if rule.matched else (~here & there)
        choice = F.when(applies & (_true(rule.condition) if rule.condition is not None else F.lit(True)), i).otherwise(choice)
    # rows that are not there yet are groups of their own, so that all is one pass
    chosen = joined.withColumn("_choice", choice).filter(here | (F.col("_choice") >= 0)).withColumn("_group", F.coalesce(of_t("_row"), -1 - F.monotonically_increasing_id()))
    acts = F.col("_choice") >= 0
    per_row = chosen.groupBy("_group").agg(
        F.sum(acts.cast("int")).alias("_n"),
        F.first(F.struct(*(F.col(c) for c in t.columns))).alias("_old"),
        F.first(F.when(acts, F.struct("_choice", *(F.col(c) for c in s.columns))), ignorenulls=True).alias("_hit"),
    )
    several = F.raise_error(F.lit("multiple source rows match a target row")).cast("boolean")
    checked = per_row.filter(F.when(F.col("_n") > 1, several).otherwise(F.lit(True)))
    flat = checked.select("_group", *(F.col(f"_old.{c}").alias(c) for c in t.columns), F.coalesce("_hit._choice", F.lit(-1)).alias("_choice"), *(F.col(f"_hit.{c}").alias(c) for c in s.columns))
    gone = F.lit(False)
    for i, rule in enumerate(rules):
        if rule.action == "delete":
            gone = gone | (F.col("_choice") == i)
    out = []
    for c in target.columns:
        old, new = of_t(c), F.lit(None)
        for i, rule in enumerate(rules):
            if rule.action == "update" and c in rule.values:
                old = F.when(F.col("_choice") == i, rule.values[c]).otherwise(old)
            if rule.action == "insert":
                new = F.when(F.col("_choice") == i, rule.values.get(c, F.lit(None))).otherwise(new)
        out.append(F.when(F.col("_group") >= 0, old.cast(target.schema[c].dataType)).otherwise(new.cast(target.schema[c].dataType)).alias(c))
    return flat.filter(~gone).select(*out)
