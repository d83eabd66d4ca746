"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import forget, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


#: Edges that one task writes, at least.
TOGETHER = 100_000


def _with_least(rows: DataFrame, key: str, value: str, tasks: int) -> tuple[DataFrame, DataFrame]:
    """rows with least(value) of their key, and the table of those. The table is written, so that a key with very many rows can be split in the join."""
    least = stored(rows.groupBy(key).agg(F.min(value).alias("w")).coalesce(tasks), "least")
    return rows.join(least.withColumnRenamed(key, "k2"), F.col(key) == F.col("k2")).drop("k2"), least


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (its least node) for every node of an edge between different nodes.

    Each round links larger neighbours to the least one (large star), then all smaller ones to
    the least (small star); every round's edges are written to the shared folder. Rounds grow with
    the logarithm of the longest path. Null ends are left out, and edges from a node to itself; repeated
    edges count once; without edges there are no rows. The result is written: forget() it.
    """
    ends = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges_now = ends.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct()
    now = stored(edges_now, "edges")
    state = _state(now)
    tasks = 8 + state[0] // TOGETHER  # few edges don't need the tasks that texts do
    while True:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        joined, least1 = _with_least(both, "n", "m", tasks)
        large = stored(joined.filter("m > n").select(F.col("m").alias("u"), F.least("w", "n").alias("v")).distinct().coalesce(tasks), "large")
        joined, least2 = _with_least(large, "u", "v", tasks)
        small = joined.filter("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(least2.select("u", F.col("w").alias("v")))
        following = stored(small.distinct().coalesce(tasks), "edges")
        forget(now, least1, large, least2)
        before, state, now = state, _state(following), following
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).coalesce(tasks), "components")
    forget(now)
    return out


def reached(linked: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Least name that each row reaches by links."""
    label, top = name.copy(), np.iinfo(np.int64).max
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], top).min(1, initial=top))
        if (best == label).all():
            return label
        label = best
