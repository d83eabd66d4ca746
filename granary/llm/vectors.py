"""Embedding near-duplicates by spherical-cap filters.

Equal vectors of a label are one class. A filter direction is a product code: a random rotation splits
the space into blocks, each with CODES random unit vectors, and one of each block together make
a direction. Every class is list-decoded to all directions whose cap holds it: those whose score lies within MARGIN
of the vector's best one, found block by block without looking at the others. Classes that share a
filter (and label) are compared by cosine in double precision; filters with many classes are cut
into blocks of BLOCK, each pair of blocks a task of its own. A pair counts in its first common filter
only. Links inside a task are reduced to the counts of each class and to a spanning star of each local component,
so pairs are never written out, however large a group is.

The search is approximate in the pairs that it looks at, never in those that it reports: recall is
measured against brute force in the tests. Vectors that are null, empty, zero or hold null or
non-finite components, and rows without a label, link with nothing. Equal rows are different vectors
and link with each other. Vectors of different length, and of different labels, are never compared. Ties at
exactly the least cosine link. Columns beyond those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.batches import groups
from granary.llm.common import forget, stored
from granary.llm.components import components, reached

LEAST = 0.98
CODES = 64
#: Blocks of a code, for inputs of any size.
BLOCKS = 2
#: Times 1 / sqrt(dimensions): how far below its best score a vector still enters a filter.
MARGIN = 0.5
BLOCK = 512
SEED = 11

BUCKETS = T.StructType([T.StructField("lab", T.LongType()), T.StructField("dim", T.LongType()), T.StructField("filter", T.LongType()), T.StructField("label", T.StringType()), T.StructField("filters", T.ArrayType(T.LongType())), T.StructField("ck", T.LongType()), T.StructField("size", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
LINKS = T.StructType([T.StructField("ck", T.LongType()), T.StructField("n", T.LongType()), T.StructField("root", T.LongType())])


def code(dim: int, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation, and each block's unit vectors."""
    rng = np.random.default_rng((SEED, dim, blocks))
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        book = rng.standard_normal((CODES, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
    return rotation, books


def decode(unit: np.ndarray, rotation: np.ndarray, books: list[np.ndarray], margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all directions within margin / sqrt(dimensions) of each row's best, a row's directions in order."""
    turned = unit @ rotation
    margin /= np.sqrt(unit.shape[1])
    row, lost, name, at = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64), 0
    for book in books:
        score = turned[:, at : at + book.shape[1]] @ book.T
        at += book.shape[1]
        deficit = score.max(1, keepdims=True) - score
        together = lost[:, None] + deficit[row]
        i, c = np.nonzero(together <= margin)
        row, lost, name = row[i], together[i, c], name[i] * CODES + c
    order = np.lexsort((name, row))
    return row[order], name[order]


def _bucket_rows(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            ck, lab, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            flat, offsets = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64), batch.column(4).offsets.to_numpy()
            offsets = offsets - offsets[0]
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                x = flat[offsets[mine][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                if dim not in made:
                    made[dim] = code(int(dim), blocks)
                for a in range(0, len(mine), 2000):
                    row, name = decode(unit[a : a + 2000], *made[dim])
                    count = np.bincount(row, minlength=len(unit[a : a + 2000]))
                    first = np.cumsum(count) - count
                    where = mine[a + row]
                    inner = np.repeat(first[row], count[row]) + np.arange(count[row].sum()) - np.repeat(np.cumsum(count[row]) - count[row], count[row])
                    filters = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[row])), pa.int32()), pa.array(name[inner]))
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * dim, pa.int32()), pa.array(unit[a + row].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(lab[where]), pa.array(np.full(len(row), dim, np.int64)), pa.array(name), batch.column(2).take(pa.array(where)), filters, pa.array(ck[where]), pa.array(size[where]), vectors], BUCKETS.fieldNames())

    return run


def _compare(rows: dict[str, np.ndarray], least: float) -> tuple | None:
    """Counts and local roots of one task's rows: one block, or two that meet."""
    n = len(rows["ck"])
    if n < 2:
        return None
    unit, side, ck = rows["v"], rows["side"], rows["ck"]
    linked = unit @ unit.T >= least
    linked &= (ck[:, None] != ck[None, :]) & (rows["label"][:, None] == rows["label"][None, :])
    if rows["i"][0] != rows["j"][0]:
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return None
    here = rows["filter"][0]
    sizes = np.array([len(x) for x in rows["filters"]])
    flat, owner = np.concatenate(rows["filters"]), np.repeat(np.arange(n), sizes)
    before = flat < here
    names, column = np.unique(flat[before], return_inverse=True)
    member = np.zeros((n, len(names)), np.float32)
    member[owner[before], column] = 1
    first = linked & ~((member @ member.T) > 0)
    count = first.astype(np.int64) @ rows["size"]
    some = linked.any(1)
    return ck[some], count[some], reached(linked, ck)[some]


def _link_rows(least: float):
    names = ("lab", "dim", "filter", "i", "j", "side", "label", "filters", "ck", "size", "v")

    def numpy_rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names) if c not in ("v", "label")}
        return out | {"v": np.stack(batch.column(10).to_numpy(zero_copy_only=False)), "label": np.unique(batch.column(6).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 5):
            if rows.num_rows > 1 and (got := _compare(numpy_rows(rows), least)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], LINKS.fieldNames())

    return run


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vector = F.col(vector_col)
    sound = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    usable = sound & F.col(label_col).isNotNull()
    second = F.when(usable, F.xxhash64(vector_col, label_col, F.lit(2)))
    rows = table.select(F.col(id_col).alias("vec_id"), F.when(usable, F.xxhash64(label_col, vector_col)).alias("ck"), second.alias("kk"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))
    grouped = rows.filter("ck IS NOT NULL").groupBy("ck", "kk", "label", "v").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = stored(grouped, "classes")
    buckets = stored(classes.select("ck", F.xxhash64("label").alias("lab"), "label", "size", "v").mapInArrow(_bucket_rows(BLOCKS), BUCKETS), "buckets")
    place = ("lab", "dim", "filter")
    large = stored(buckets.groupBy(*place).agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK).select(*(F.col(c).alias(f"{c}2") for c in place), "rows"), "large")
    same = (F.col("lab") == F.col("lab2")) & (F.col("dim") == F.col("dim2")) & (F.col("filter") == F.col("filter2"))
    cut = buckets.join(large, same, "left").withColumn("nb", F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK).cast("long"))
    placed = cut.withColumn("side", F.pmod(F.xxhash64("ck", F.lit(1)), F.col("nb"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    tasks = placed.select(*place, F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "label", "filters", "ck", "size", "v")
    links = stored(tasks.repartition(*place, "i", "j").sortWithinPartitions(*place, "i", "j", "ck").mapInArrow(_link_rows(least), LINKS), "links")
    forget(buckets, large)
    counts = links.groupBy("ck").agg(F.sum("n").alias("n"))
    found = components(links.filter("ck <> root"), "ck", "root")
    per = classes.select("ck", "kk", "size", "least").join(counts, "ck", "left").join(found.withColumnRenamed("node", "ck"), "ck", "left").withColumn("component", F.coalesce("component", "ck"))
    per = stored(per, "per")
    forget(classes, links, found)
    smallest = per.groupBy("component").agg(F.min("least").alias("component_id"))
    stats = stored(per.join(smallest, "component").select(F.col("ck").alias("c2"), F.col("kk").alias("k2"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "stats")
    forget(per)
    joined = rows.drop("v", "label").join(stats, (F.col("ck") == F.col("c2")) & (F.col("kk") == F.col("k2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
