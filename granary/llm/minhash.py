"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its shingles (SHINGLE words; a shorter text is one shingle), a shingle's
weight being the number of times it occurs. Darts are thrown by hash at the plane of weight and rank of each
element; a dart hits a document if it falls below the element's weight there, so documents that share weight
share darts. Only darts of small rank are thrown at all: about TABLES ln TABLES + 2 TABLES for a document of
any length. Each dart falls into one coordinate, and the signature keeps each coordinate's dart of least rank;
where a coordinate stays empty, the rank limit is doubled. Equal coordinates have the probability of the
weighted Jaccard similarity (sum of lesser weights by sum of greater ones; without repeated shingles that of
the sets). Signatures are cut into BANDS bands of ROWS; documents that share a band are candidates and are
compared exactly. At similarity 0.8 a pair shares no band with a probability of 2e-4.

Equal texts are one class before anything is compared. In each band's bucket all members are compared with
the one of least key, and where the bucket then holds several components, those outside are compared with the
member that has the most links: both cost as many comparisons as there are members. Buckets that still
hold several components are compared exactly across components, without listing pairs: the members outside
of the bucket's largest component are dealt into blocks, each block meets every other one and the blocks of
the largest component in a task of its own, which counts common shingles by matrix products and gives back
at most one link for each member. So no candidate pair that could join two components is left out.

Nulls: a null text, and one without words, is a class of its own row. A null id is kept; its rows are
never chosen as the one that represents a class unless there is no other. Equal rows, and rows of equal text, share a class;
rows of one id with different texts are classed each by its own text. Long texts are read whole. Columns
beyond those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.batches import Vocabulary, chunks, groups
from granary.llm.common import BROADCAST_BYTES, forget, maybe_broadcast, stored
from granary.llm.components import components, reached

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 36, 7
TABLES = BANDS * ROWS
#: Members, and shingles, of a block in the comparison across components.
BLOCK, ELEMENTS = 128, 1 << 21
#: What words_of() splits at, as JVM's pattern of a text that has words.
WORDED = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * (1 / (1 << 53))


class Words:
    """64-bit hashes of words, remembered."""

    def __init__(self) -> None:
        self.known, self.hash = Vocabulary(), np.zeros(0, np.uint64)

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        kept = self.known.shrink()
        if kept is not None:
            self.hash = self.hash[kept]
        ids = [self.known.numbers(x) for x in texts]
        fresh = self.known.take_fresh()
        if fresh:
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1
            codes = np.frombuffer(("\x00".join(fresh) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            starts = np.cumsum(sizes) - sizes
            place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
            self.hash = np.concatenate([self.hash, _mix(np.add.reduceat(_mix(codes * _MUL + place), starts))])
        if ids:
            self.known.used(np.concatenate(ids))
        return [self.hash[i] for i in ids]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(words: list[np.ndarray], weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight) of distinct shingles of documents given as word hashes; weight 1, or the count."""
    sizes = np.array([len(w) for w in words])
    grams = np.where(sizes == 0, 0, np.maximum(sizes - SHINGLE + 1, 1))
    flat = np.concatenate([*words, np.zeros(SHINGLE, np.uint64)])
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(words)), grams)
    at = begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    last = (begin + sizes)[doc]
    h = np.zeros(len(doc), np.uint64)
    for i in range(SHINGLE):
        inside = at + i < last
        h = _mix(h * _MUL + np.where(inside, flat[np.minimum(at + i, len(flat) - 1)], np.uint64(1)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc))).astype(np.float64)
    return doc[first], h[first], count if weighted else np.ones(len(first))


def darts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, dart, rank) of the darts below each element's weight and its document's rank limit.

    Weights are cut into cells [2^c - 1, 2^(c+1) - 1); each cell of an element is a Poisson process along
    the rank axis, of the cell's width as its rate, drawn by hashing element, cell and number; a dart's
    weight is uniform in its cell. So a dart depends on its element alone, whatever document throws it.
    """
    out = []
    cell = 0
    live = np.arange(len(doc))
    while len(live):
        low, width = float((1 << cell) - 1), float(1 << cell)
        live = live[weight[live] > low]
        going, rank = live, np.zeros(len(live))
        seed = _mix(element[live] + np.uint64(cell * int(_MUL) % (1 << 64)))
        number = 0
        while len(going):
            h = _mix(seed + np.uint64((2 * number + 1) * int(_MUL) % (1 << 64)))
            rank = rank - np.log(_uniform(h)) / width
            stay = rank < limit[doc[going]]
            going, rank, seed, h = going[stay], rank[stay], seed[stay], h[stay]
            hit = low + width * _uniform(_mix(h ^ _MUL)) <= weight[going] if cell else np.ones(len(going), bool)
            out.append((doc[going[hit]], _mix(h[hit] + np.uint64(5)), rank[hit]))
            number += 1
        cell += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, documents: int, tables: int = TABLES) -> np.ndarray:
    """The dart of least rank by document and coordinate; rows of documents without elements stay 0."""
    out = np.zeros((documents, tables), np.uint64)
    total = np.bincount(doc, weight, documents)
    throws = tables * np.log(tables) + 2 * tables
    limit = np.where(total > 0, throws / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        mine = todo[doc]
        d, dart, rank = darts(doc[mine], element[mine], weight[mine], limit)
        slot = d * tables + (dart % np.uint64(tables)).astype(np.int64)
        first = np.full(documents * tables, np.inf)
        np.minimum.at(first, slot, rank)
        earliest = rank == first[slot]
        best = np.zeros(documents * tables, np.uint64)
        np.maximum.at(best, slot[earliest], dart[earliest])
        filled = np.isfinite(first).reshape(documents, tables)
        done = todo & filled.all(1)
        out[done] = best.reshape(documents, tables)[done]
        todo &= ~done
        limit = np.where(todo, limit * 2, limit)
    return out


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature; different bands never share one."""
    documents, tables = signature.shape
    parts = signature.reshape(documents, count, tables // count)
    h = np.zeros((documents, count), np.uint64) + np.arange(count, dtype=np.uint64) * _MUL
    for i in range(parts.shape[2]):
        h = _mix(h * _MUL + parts[:, :, i])
    return h


def _sketch(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts, 1_000_000):
                words = memory.of([words_of(t) for t in texts[a:b]])
                doc, element, weight = shingles(words, weighted)
                h = bands(signatures(doc, element, weight, b - a))
                n = np.bincount(doc, np.round(weight), b - a).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))), pa.int32()), pa.array(h[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(2)), pa.array(n), lists], SKETCH.fieldNames())

    return run


def elements(texts: list[str | None], memory: Words, weighted: bool = True) -> list[np.ndarray]:
    """Each text's shingles as a sorted array of distinct values; the second and later occurrences of a shingle are elements of their own."""
    doc, h, weight = shingles(memory.of([words_of(t) for t in texts]), weighted)
    times = np.round(weight).astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc, h = np.repeat(doc, times), np.repeat(h, times)
    h = np.where(nth > 0, _mix(h + nth.astype(np.uint64) * _MUL), h)
    order = np.lexsort((h, doc))
    return np.split(h[order], np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard of two arrays of distinct values."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both / max(len(left) + len(right) - both, 1)


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """similarity() of all pairs of a block, by matrix products over the elements that occur more than once."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = count > 1
    keep = twice[column]
    owner, column = np.repeat(np.arange(n), sizes.astype(np.int64))[keep], (np.cumsum(twice) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(twice.sum())
    both, width = np.zeros((n, n)), max(1, min(total, 4_000_000 // n))
    for first in range(0, total, width):
        a, b = np.searchsorted(column, (first, first + width))
        held = np.zeros((n, width), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        both += held @ held.T
    return both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1)


def _verify(least: float, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            known: dict[str, np.ndarray] = {}
            held = 0
            for i, pair in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if held > ELEMENTS:
                    known.clear()
                    held = 0
                for t in pair:
                    if t not in known:
                        known[t] = elements([t], memory, weighted)[0]
                        held += len(known[t])
                keep[i] = similarity(known[pair[0]], known[pair[1]]) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _meet(least: float, weighted: bool):
    """Over rows (band, i, j, outside, key, comp, t) of one or two blocks: (a, b), a member and the least one that it reaches by links across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for rows in groups(batches, 3):
            outside, key, comp = (rows.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5))
            if len(key) < 2 or (comp == comp[0]).all():
                continue
            linked = similarities(elements(rows.column(6).to_pylist(), memory, weighted)) >= least
            linked &= (comp[:, None] != comp[None, :]) & (outside[:, None] | outside[None, :])
            root = reached(linked, key)
            some = root != key
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(root[some])], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST, weighted: bool = True) -> DataFrame:
    """Those of the pairs (a, b) of keys whose texts are similar enough; texts has one row for each key."""
    ta = texts.select(F.col("key").alias("ka"), F.col("t").alias("ta"))
    tb = texts.select(F.col("key").alias("kb"), F.col("t").alias("tb"))
    with_a = pairs.join(ta, F.col("a") == F.col("ka")).select("a", "b", "ta")
    both = with_a.join(tb, F.col("b") == F.col("kb")).select("a", "b", "ta", "tb")
    return both.mapInArrow(_verify(least, weighted), "a long, b long")


def _close(n: Column, m: Column, least: float) -> Column:
    """Whether sets of such sizes can be that similar."""
    return F.least(n, m) >= least * F.greatest(n, m) - 1e-9


def _placed(members: DataFrame, edges: DataFrame) -> DataFrame:
    """band, key, n, rep, comp, links: members of buckets with their component (of those without links, themselves) and number of links. Written."""
    found = components(edges, "a", "b")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    state = stored(found.join(ends.groupBy("node").agg(F.count("*").alias("links")), "node"), "state")
    joined = members.select("band", "key", "n", "rep").join(state, F.col("key") == F.col("node"), "left")
    out = stored(joined.select("band", "key", "n", "rep", F.coalesce("component", "key").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")), "placed")
    forget(found, state)
    return out


def _across(placed: DataFrame, texts: DataFrame, least: float, weighted: bool) -> DataFrame:
    """Links (a, b) between the components of every bucket, at most one for each member and task."""
    of_comp = placed.groupBy("band", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("e"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(2))).alias("y"))
    whole = of_comp.groupBy("band").agg(F.count("*").alias("comps"), F.max(F.struct("m", "e", "comp")).alias("main"), F.sum("m").alias("m"), F.sum("e").alias("e"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    # buckets of the same members are one
    once = whole.filter("comps > 1").groupBy("x", "y", "m").agg(F.min(F.struct("band", "main", "e")).alias("of"))
    parts = lambda m, e: F.ceil(F.greatest(m / BLOCK, e / ELEMENTS, F.lit(1.0))).cast("long")
    open_ = stored(once.select(F.col("of.band").alias("b2"), F.col("of.main.comp").alias("main"), parts(F.col("m") - F.col("of.main.m"), F.col("of.e") - F.col("of.main.e")).alias("no"), parts(F.col("of.main.m"), F.col("of.main.e")).alias("nm")), "open")
    rows = placed.join(open_, F.col("band") == F.col("b2")).withColumn("outside", F.col("comp") != F.col("main"))
    rows = rows.withColumn("x", F.when(F.col("outside"), F.pmod(F.xxhash64("key", F.lit(3)), F.col("no"))).otherwise(F.col("no") + F.pmod(F.xxhash64("key", F.lit(3)), F.col("nm"))))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("outside"), F.col("no") + F.col("nm") - 1).otherwise(F.col("no") - 1))))
    rows = rows.select("band", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "outside", "key", "comp")
    told = rows.join(texts.withColumnRenamed("key", "k2"), F.col("key") == F.col("k2")).select(*rows.columns, "t")
    links = stored(told.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "key").mapInArrow(_meet(least, weighted), "a long, b long"), "across")
    forget(open_)
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, weighted: bool = True) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), kept (whether it represents its class), class_size.

    Of equal ids in a class all are marked kept; deduplicate() keeps one row.
    """
    return _classes(docs, id_col, text_col, least, weighted).drop("k1")


def _linked(sketch: DataFrame, source: DataFrame, least: float, weighted: bool) -> DataFrame:
    """node, component of all distinct texts that are near another one, by text hash. Written."""
    unique = sketch.filter("n > 0").groupBy("k1").agg(F.min("doc_id").alias("id"), F.first(F.struct("n", "bands")).alias("x"))
    unique = stored(unique.select(F.col("k1").alias("key"), "id", "x.n", "x.bands"), "unique")
    buckets = unique.select("key", "id", "n", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct("key", "n")).alias("r")).filter("m > 1")
    shared = stored(shared.select(F.col("band").alias("band2"), F.col("r.key").alias("rep"), F.col("r.n").alias("rn")), "shared")
    # only members of shared buckets are of interest from here on
    members = stored(buckets.join(shared, F.col("band") == F.col("band2")).select("band", "key", "id", "n", "rep", "rn"), "members")
    forget(unique, shared)
    # one row of each text in question, by its least id: equal texts are many, ids are not. Rows of equal id and text are one
    wanted = stored(members.select("key", "id").distinct(), "wanted")
    # names of 16 bytes are sent to every task if they are few, so that texts stay where they are; else texts are shuffled once
    few = wanted.count() * 32 <= BROADCAST_BYTES
    texts = source.join(maybe_broadcast(wanted, few), (F.col("k1") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    texts = stored(texts.groupBy(F.col("k1").alias("key")).agg(F.first("t").alias("t")), "texts")
    pairs = members.filter(F.col("key") != F.col("rep")).filter(_close(F.col("n"), F.col("rn"), least)).select(F.col("key").alias("a"), F.col("rep").alias("b")).distinct()
    edges = stored(verified(pairs, texts, least, weighted), "links")
    forget(wanted)

    # again with another one: the bucket's member that most others are known to be near, as copies are nearer to what they were made from than to each other
    placed = _placed(members, edges)
    hubs = placed.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.max(F.when(F.col("key") != F.col("rep"), F.struct("links", "key", "n", "comp"))).alias("hub"))
    hubs = stored(hubs.filter("c1 <> c2").select(F.col("band").alias("band2"), "hub"), "hubs")
    met = placed.join(hubs, F.col("band") == F.col("band2")).filter((F.col("comp") != F.col("hub.comp")) & (F.col("key") != F.col("rep")) & _close(F.col("n"), F.col("hub.n"), least))
    more = stored(verified(met.select(F.greatest("key", "hub.key").alias("a"), F.least("key", "hub.key").alias("b")).distinct(), texts, least, weighted), "more")
    forget(placed, hubs)

    # the rest: across components inside a bucket
    placed = _placed(members, edges.unionByName(more))
    last = _across(placed, texts, least, weighted)
    forget(members, texts, placed)
    out = components(edges.unionByName(more).unionByName(last), "a", "b")
    forget(edges, more, last)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float, weighted: bool = True) -> DataFrame:
    """classes(), and the texts' hashes."""
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, F.lit(1)).alias("k1"), text.alias("t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, F.lit(1)).alias("k1"), (text.isNull() | ~text.rlike(WORDED)).alias("bare"))
    sketch = stored(source.filter(F.col("t").isNotNull()).mapInArrow(_sketch(weighted), SKETCH), "sketch")
    groups_ = _linked(sketch, source, least, weighted)
    forget(sketch)
    named = rows.filter(~F.col("bare")).groupBy("k1").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("size"))
    named = stored(named.join(groups_.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1")), "named")
    forget(groups_)
    whole = named.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("size").alias("class_size"))
    per = stored(named.join(whole, "component").select(F.col("k1").alias("kk"), "class_id", "class_size"), "per")
    forget(named)
    out = rows.join(per, (F.col("k1") == F.col("kk")) & ~F.col("bare"), "left")
    own = F.coalesce("class_id", "doc_id")
    out = out.select("doc_id", "k1", own.alias("class_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
    out.granary_path = per.granary_path
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs, all columns, with one row of each class. Rows of equal id and text are one.

    Rows without an id go if a row of their class has one; else one of each of their texts stays. Rows of one
    id with different texts stay or go each by its own text.
    """
    # written before it is made distinct: a join that feeds an aggregate can't be split where one text has very many rows
    found = _classes(docs, id_col, text_col, least)
    named = stored(found.filter("kept").select(F.col("doc_id").alias("__i"), F.col("k1").alias("__k")), "named")
    kept = stored(named.distinct(), "kept")
    forget(found, named)
    once = docs.withColumn("__h", F.xxhash64(F.col(text_col), F.lit(1))).dropDuplicates([id_col, "__h"])
    return once.join(kept, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__k")), "left_semi").drop("__h")
