"""Hierarchical Pitman-Yor language model over a distributed corpus.

Every word, and the start of a text, is a context restaurant for the words that follow it; all of them send their tables as
customers to the one root restaurant, that of the empty context, whose base is uniform over the training words and one unknown
word. Words are seated by Gibbs sweeps: the customers of a word leave all restaurants and are seated again, given all other words'
seats, in parties of an eighth of those seated so far (one at least), each party by one draw of how many of it open a table. What words
have in common are only totals by restaurant and of the root, so words are dealt over the cluster by hash, sweeps run everywhere at
once, and totals are exchanged between passes; between passes discounts and strengths are drawn too: a discount of each level from
a beta distribution on the words seen once and twice, a strength of each level from its posterior given the totals. A probability is
the mean of the predictive probabilities of several sweeps.

A cell is a word after a context. Cells with their customers travel to their word's bucket, which seats them; each
bucket's totals of a context travel to the context's bucket and come back added up, so no table of contexts is ever in one place.
Scored cells and the cells of documents meet by the cell's hash, so frequent words are spread, and sums go back to blocks of
documents. Buckets grow in number with the documents, and each has a seed of its own, so neither their size nor the scores depend on
how many tasks there are. Words are told apart by 64-bit hashes, and cells by such hashes of a bucket.

A null text is an empty one: it has the end as its only token. A null id is kept. Equal rows count and
score like any others; rows of one id with different texts are scored each by its own. Texts of any length are read whole.
Columns beyond those named are ignored; an empty table gives no rows. Without training documents every word is unknown.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.batches import CHUNK
from granary.llm.common import forget, stored

#: Names of contexts that are no words: none (the root itself), the start of a text.
NONE, START = 0, 1
#: Restaurants in a table of totals, if not said otherwise.
CONTEXTS = 256
#: Contexts by default: all words. A number gives the plainer model to compare with, in which only the most frequent words of a sample are contexts.
HEAD: int | None = None
#: Documents, in expectation, that show which words are frequent: COMMON of them travel as contexts under short names.
SAMPLE, COMMON = 8_000, 65_000
#: Documents to a bucket; buckets of words and of cells at least.
TO_BUCKET, LEAST_BUCKETS, LEAST_CELL_BUCKETS = 4_000, 256, 64
#: Documents ask for their cells in so many rounds, each for some of the buckets, so that less is on disk at once.
ROUNDS = 2
#: Words that a task holds before it sends them on.
TOGETHER = 1_000_000
#: Bytes of text hashed at once; places in a word whose part of its hash is looked up.
HASHED, LOOKED_UP = 1 << 19, 64
BURN, SAMPLES = 1, 3
#: A word's log10 probability and log10(count + 1) travel as whole numbers of 1 / these, so sums of them do not depend on their order; they are rounded by 7.5e-9 and 5e-13 at most.
UNIT, BASE_UNIT = 2**26, 2**40
END = b"\n"
CELLS, ROOMS, SCORED, OCCURRING, KEYS, SUMS, TABLES_SEEN, CUSTOMERS_SEEN, TOTAL = range(9)

PACKED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()), T.StructField("d", T.BinaryType())])
_NAMES = PACKED.fieldNames()
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between white space of ASCII, A-Z folded, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _terms(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What bytes at their places in a word add to its hash."""
    mixed = (code + np.uint64(1)) * _MUL ^ (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _named(h: np.ndarray) -> np.ndarray:
    return np.maximum(h ^ (h >> np.uint64(32)), np.uint64(START + 1))


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    codes = np.frombuffer(b"\x00".join(words) + b"\x00", np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64)
    return _named(np.add.reduceat(_terms(codes, place), starts))


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_FOLDED = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64)
#: By place and byte: its part of a hash; white space has none.
_TERMS = np.where(_SPACE, np.uint64(0), _terms(_FOLDED, np.arange(LOOKED_UP, dtype=np.uint64)[:, None])).ravel()


def _hashes_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """_hashes of the words between white space that lie at these places of the bytes, A-Z folded."""
    found = [np.zeros(0, np.uint64)]
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), HASHED)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        codes, begins = data[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
        place = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
        far = np.flatnonzero(place >= LOOKED_UP)
        far = far[~_SPACE[codes[far]]]
        later = _terms(_FOLDED[codes[far]], place[far].astype(np.uint64))
        terms = _TERMS[np.minimum(place, LOOKED_UP - 1) << 8 | codes]
        terms[far] = later
        found.append(np.add.reduceat(terms, begins))
    return _named(np.concatenate(found) + _terms(np.uint64(0), (ends - starts).astype(np.uint64)))


def _cell_names(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """64-bit hashes of cells."""
    h = (word ^ (context * _MUL + (context >> np.uint64(31)))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _by(dealt: np.ndarray) -> np.ndarray:
    """An order by small numbers that keeps the order of equal ones; of 16 bits, they are sorted by counting."""
    return np.argsort(dealt.astype(np.uint16) if not len(dealt) or dealt.max() < 1 << 16 else dealt, kind="stable")


def _distinct(names: np.ndarray) -> np.ndarray:
    names = np.sort(names)
    return names[np.append(True, names[1:] != names[:-1])]


def _finder(known: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Gives places of names among known ones, which are in order and hold them all: steps from the first one with the same leading bits."""
    bits = min(max(len(known).bit_length(), 1), 22)
    shift = np.uint64(64 - bits)
    starts = np.append(0, np.cumsum(np.bincount((known >> shift).astype(np.int64), minlength=1 << bits)))

    def places(names: np.ndarray) -> np.ndarray:
        at = starts[(names >> shift).astype(np.int64)]
        off = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != names)
        while len(off):
            at[off] += 1
            off = off[known[at[off]] != names[off]]
        return at

    return places


def _readings(texts: pa.Array, contexts: np.ndarray | None) -> Iterator[tuple]:
    """Texts in ranges of about CHUNK bytes, read as words_of reads them: begin and end of a range; of all its words in order: document, hash, context; and the words of each document."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(offsets[:-1], np.arange(offsets[0], offsets[-1], CHUNK)), [len(texts)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        data, borders = whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        space, border = _SPACE[data], np.zeros(len(data) + 1, bool)
        border[borders] = True
        starts = np.flatnonzero(~space & (border[:-1] | np.append(True, space[:-1])))
        ends = np.flatnonzero(~space & (border[1:] | np.append(space[1:], True))) + 1
        edges = np.searchsorted(starts, borders)
        word, sizes = np.insert(_hashes_at(data, starts, ends), edges[1:], _hashes([END])), np.diff(edges) + 1
        context = np.append(np.uint64(START), word[:-1])
        if contexts is not None:
            context[~np.isin(context, contexts)] = NONE
        context[np.cumsum(sizes) - sizes] = START
        yield a, b, np.repeat(np.arange(b - a), sizes), word, context, sizes


def _record(kind: int, bucket: list, block: list, n: list, *parts: list) -> pa.RecordBatch:
    size = len(bucket)
    parts = [*parts, *([[None] * size] * (4 - len(parts)))]
    arrays = [pa.array([kind] * size, pa.int32()), *(pa.array(x, pa.int64()) for x in (bucket, block, n)), *(pa.array(x, pa.binary()) for x in parts)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of runs of equal ones, and their lengths."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[first], np.diff(np.append(first, len(x))).astype(np.uint32)


def _by_plane(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes: all lowest ones first, and so on, so that small numbers compress to their low bytes."""
    return _by_plane(x).tobytes()


def _numbers(planes: bytes | np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _codes(names: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names as places among the common ones, if they are there, and whether they are."""
    place = np.minimum(np.searchsorted(common, names), len(common) - 1)
    hit = common[place] == names
    return np.where(hit, place, COMMON + 2).astype(np.uint16), hit


def _coded(names: np.ndarray, code: np.ndarray, hit: np.ndarray) -> bytes:
    """Names as places among the common ones; the others whole, behind."""
    return _planes(code) + _planes(names[~hit])


def _decoded(coded: np.ndarray, n: int, common: np.ndarray) -> np.ndarray:
    place = _numbers(coded[: 2 * n], np.uint16)
    names = common[np.minimum(place, len(common) - 1)]
    names[place == COMMON + 2] = _numbers(coded[2 * n :], np.uint64)
    return names


def _pieces(x: np.ndarray, edges: np.ndarray) -> list[bytes]:
    planes = _by_plane(x)
    return [planes[:, a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _dealer(contexts: np.ndarray | None, common: np.ndarray, buckets: int):
    """First pass, over (training, text): cells and their customers (0 outside of training), by word's bucket."""

    def cells(held: list[tuple]) -> pa.RecordBatch:
        word, context, train = (np.concatenate(x) for x in zip(*held, strict=True))
        # numbers for names, in order of buckets and names: then one sort of whole numbers adds equal cells up
        names = _distinct(np.append(word, np.array([NONE, START], np.uint64)))
        bucket = _bucket(names, buckets)
        order = _by(bucket)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        places = _finder(names)
        drawn = np.sort((rank[places(word)] * len(names) + places(context)) * 2 + train)
        cell = drawn >> 1
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        customers = np.add.reduceat(drawn & 1, first)
        word, context = np.divmod(cell[first], len(names))
        code, hit = (x[context] for x in _codes(names, common))
        word, context = order[word], names[context]
        some, n = _runs(bucket[word])
        word = names[word]
        edges = np.append(0, np.cumsum(n, dtype=np.int64))
        parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        words = [_runs(word[x]) for x in parts]
        return _record(CELLS, some.tolist(), [0] * len(some), n.tolist(), [_planes(w) for w, _ in words], [_planes(c) for _, c in words], [_coded(context[x], code[x], hit[x]) for x in parts], _pieces(customers.astype(np.uint32), edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool).astype(np.int64)
            for a, b, doc, word, context, _ in _readings(batch.column(1), contexts):
                held.append((word, context, train[a:b][doc]))
                size += len(word)
                if size >= TOGETHER:
                    yield cells(held)
                    held, size = [], 0
        if held:
            yield cells(held)

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows with their packed numbers as views of the batch."""
    columns = []
    for column, field in zip(batch.columns, batch.schema, strict=True):
        if pa.types.is_binary(field.type) or pa.types.is_large_binary(field.type):
            column = column.cast(pa.large_binary())
            _, ends, data = column.buffers()
            ends, data = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1].tolist(), np.frombuffer(data or b"", np.uint8)
            columns.append([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        else:
            columns.append(column.to_pylist())
    for row in zip(*columns, strict=True):
        yield dict(zip(batch.schema.names, row, strict=True))


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by key."""
    held: list[dict] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        for row in _rows(batch):
            now = tuple([row[k] for k in key])
            if held and now != last:
                yield last, held
                held = []
            held.append(row)
            last = now
    if held:
        yield last, held


def _join(rows: list[dict], name: str, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    edges = np.cumsum([0, *(len(r[name]) // size for r in rows)]).tolist()
    planes = np.empty((size, edges[-1]), np.uint8)
    for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
        planes[:, a:b] = r[name].reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _gatherer(common: np.ndarray):
    """After the exchange: one row of cells for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _groups(batches, ("bucket",)):
            word = np.concatenate([np.repeat(_numbers(r["a"], np.uint64), _numbers(r["b"], np.uint32)) for r in rows])
            context = np.concatenate([_decoded(r["c"], r["n"], common) for r in rows])
            words, names = _distinct(word), _distinct(np.append(context, np.uint64(NONE)))
            cell = _finder(words)(word) * len(names) + _finder(names)(context)
            order = np.argsort(cell)
            cell = cell[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            customers = np.add.reduceat(_join(rows, "d", np.uint32).astype(np.int64)[order], first)
            word, context = np.divmod(cell[first], len(names))
            # contexts as places among the bucket's own names, which follow them
            yield _record(CELLS, [bucket], [0], [len(first)], [_planes(words)], [_planes(_runs(word)[1])], [_planes(context.astype(np.uint32)) + _coded(names, *_codes(names, common))], [_planes(customers)])

    return run


class Totals:
    """What words have in common: customers and tables of some restaurants; of all: the root's customers and tables, words seen once and twice, number of words, discounts and strengths (of contexts, of the root)."""

    def __init__(self, rooms: int = CONTEXTS) -> None:
        self.customers = np.zeros(rooms)
        self.tables = np.zeros(rooms)
        self.root_customers = self.root_tables = 0.0
        self.ones = np.zeros((2, 2))  # words seen once and twice: in contexts, at the root
        self.words = self.tokens = 0
        self.discounts, self.strengths = (0.5, 0.5), (1.0, 1.0)

    def numbers(self) -> list[int]:
        """Whole numbers that are added up over buckets: their sums do not depend on the order."""
        return [int(x) for x in (*self.ones.ravel(), self.root_customers, self.root_tables, self.words, self.customers.sum())]

    def of(self, customers: np.ndarray, tables: np.ndarray) -> Totals:
        """The same for other restaurants."""
        out = Totals()
        out.__dict__.update(self.__dict__, customers=customers, tables=tables)
        return out

    def draw(self, rng: np.random.Generator, seen: tuple | None = None) -> None:
        """Discounts from a beta distribution on the words seen once and twice; strengths from their posterior given the totals, on a grid.

        seen: (numbers, how many contexts have them) of customers and of tables; if not given, those of these restaurants.
        """
        self.discounts = tuple(float(np.clip(rng.beta(1 + once, 1 + 2 * twice), 0.02, 0.95)) for once, twice in self.ones)
        if seen is None:
            some = np.flatnonzero(self.customers[START:] > 0) + START
            seen = tuple(np.unique(x[some], return_counts=True) for x in (self.customers, self.tables))
        root = tuple((np.array([x]), np.array([1])) if self.root_customers else (np.zeros(0), np.zeros(0)) for x in (self.root_customers, self.root_tables))
        self.strengths = tuple(_strength(*level, d, rng) for level, d in zip((seen, root), self.discounts, strict=True))


GRID = np.geomspace(0.01, 10_000, 61)


def _strength(customers: tuple, tables: tuple, discount: float, rng: np.random.Generator) -> float:
    """A strength drawn from its posterior given (numbers, restaurants that have them) of customers and tables; uniform in its logarithm before."""

    def weight(s: float) -> float:
        opened = sum(n * ((t - 1) * math.log(discount) + math.lgamma(s / discount + t) - math.lgamma(s / discount + 1)) for t, n in zip(*tables, strict=True))
        return opened - sum(n * (math.lgamma(s + c) - math.lgamma(s + 1)) for c, n in zip(*customers, strict=True))

    logs = np.array([weight(s) for s in GRID])
    odds = np.exp(logs - logs.max())
    return float(rng.choice(GRID, p=odds / odds.sum()))


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after customers of one word each sit down, in parties of an eighth of those seated (one at least); fresh: the weight of a new table.

    With j seated at t tables, the next opens one with probability fresh / (fresh + j - discount t).
    """
    tables = (customers > 0).astype(np.float64)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order], kind="stable")]
    left = customers[order]
    j = 1
    live = int(np.searchsorted(-left, -j, "left"))  # those with more than j
    while live:
        some = order[:live]
        party = np.minimum(max(1, j // 8), left[:live] - j)
        p = fresh[some] / (fresh[some] + j + (party - 1) / 2 - discount * tables[some])
        tables[some] += rng.binomial(party, p)
        j += max(1, j // 8)
        live = int(np.searchsorted(-left, -j, "left"))
    return tables


class Seating:
    """Seats of some words in all restaurants, given the totals; cells (word times restaurants plus restaurant) are in order of words."""

    def __init__(self, cell: np.ndarray, customers: np.ndarray, totals: Totals, seed: tuple) -> None:
        rooms = len(totals.customers)
        self.customers, self.totals = customers, totals
        word, self.context = np.divmod(cell, rooms)
        self.names, n = _runs(word)
        self.word = np.repeat(np.arange(len(n)), n)
        self.rng = np.random.default_rng(seed)
        self.bare = self.context == NONE
        self.tables = np.where(self.bare, customers, customers > 0).astype(np.float64)
        self.below = np.bincount(self.word, self.tables, len(self.names))
        self.root_tables = (self.below > 0).astype(np.float64)

    def root(self) -> np.ndarray:
        """Predictive probability of each word at the root."""
        t = self.totals
        d, s = t.discounts[1], t.strengths[1]
        total = s + t.root_customers
        return np.maximum(self.below - d * self.root_tables, 0) / total + (s + d * t.root_tables) / total / (t.words + 1)

    def own(self) -> np.ndarray:
        """What each cell has at its own context's tables."""
        t = self.totals
        return np.where(self.bare, 0, np.maximum(self.customers - t.discounts[0] * self.tables, 0) / (t.strengths[0] + t.customers)[self.context])

    def predict(self) -> np.ndarray:
        """Predictive probability of each cell."""
        return self.own() + backed_off(self.totals)[self.context] * self.root()[self.word]

    def sweep(self) -> None:
        """Every word leaves every restaurant and is seated again."""
        t = self.totals
        (d1, d0), (s1, s0) = t.discounts, t.strengths
        self.tables = np.where(self.bare, self.customers, seat(np.where(self.bare, 0, self.customers), (s1 + d1 * t.tables)[self.context] * self.root()[self.word], d1, self.rng))
        self.below = np.bincount(self.word, self.tables, len(self.names))
        base = np.full(len(self.names), (s0 + d0 * t.root_tables) / (t.words + 1))
        self.root_tables = seat(self.below.astype(np.int64), base, d0, self.rng)

    def summed(self) -> Totals:
        rooms = len(self.totals.customers)
        out = Totals()
        out.customers, out.tables = np.bincount(self.context, self.customers, rooms), np.bincount(self.context, self.tables, rooms)
        out.root_customers, out.root_tables = float(self.tables.sum()), float(self.root_tables.sum())
        inside = self.customers[~self.bare]
        out.ones = np.array([[(x == 1).sum(), (x == 2).sum()] for x in (inside, self.below)], np.float64)
        out.words = int((self.below > 0).sum())
        return out

    def averaged(self) -> tuple[np.ndarray, np.ndarray]:
        """Means over SAMPLES sweeps of what each cell has of its own, and of each word's probability at the root."""
        for _ in range(BURN):
            self.sweep()
        own, root = np.zeros(len(self.customers)), np.zeros(len(self.names))
        for _ in range(SAMPLES):
            self.sweep()
            own += self.own()
            root += self.root()
        return own / SAMPLES, root / SAMPLES


def backed_off(t: Totals) -> np.ndarray:
    """By context, the share of the root in a probability."""
    share = (t.strengths[0] + t.discounts[0] * t.tables) / (t.strengths[0] + t.customers)
    share[NONE] = 1.0
    return share


def _seated(rows: list[dict], totals: Totals, seed: int, common: np.ndarray, buckets: int) -> tuple[Seating, np.ndarray, np.ndarray, np.ndarray]:
    """The seating of a bucket's cells; words, contexts' names (the first is none) and their buckets. rows: the cells, and totals of contexts that came back, if any."""
    r = rows[0]
    words, n = _numbers(r["a"], np.uint64), _numbers(r["b"], np.uint32)
    context = _numbers(r["c"][: 4 * r["n"]], np.uint32).astype(np.int64)
    names = _decoded(r["c"][4 * r["n"] :], int(context.max()) + 1, common)
    at = _bucket(names, buckets)
    customers, tables = np.zeros(len(names)), np.zeros(len(names))
    if len(rows) > 1:
        order = _by(at)
        customers[order], tables[order] = _join(rows[1:], "b", np.uint64), _join(rows[1:], "c", np.uint64)
    cell = np.repeat(np.arange(len(words)), n) * len(names) + context
    return Seating(cell, _numbers(r["d"], np.int64), totals.of(customers, tables), (seed, r["bucket"])), words, names, at


def _summer(totals: Totals | None, common: np.ndarray, buckets: int):
    """Over cells and totals that came back: after a sweep, if there are totals, each bucket's totals of contexts, by context's bucket; and its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _groups(batches, ("bucket",)):
            seats, _, names, at = _seated(rows, totals or Totals(), 1, common, buckets)
            if totals:
                seats.sweep()
            summed = seats.summed()
            order = _by(at)
            some, n = _runs(at[order])
            edges = np.append(0, np.cumsum(n, dtype=np.int64))
            yield _record(ROOMS, some.tolist(), [bucket] * len(some), n.tolist(), *(_pieces(x[order].astype(np.uint64), edges) for x in (names, summed.customers, summed.tables)))
            numbers = summed.numbers()
            yield _record(TOTAL, list(range(len(numbers))), [0] * len(numbers), numbers)

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of contexts added up and sent back to each bucket that has them; how many contexts have how many customers and tables."""
    for (kind, bucket), rows in _groups(batches, ("kind", "bucket")):
        if kind == TOTAL:
            yield _record(TOTAL, [bucket], [0], [sum(r["n"] for r in rows)])
            continue
        every = _join(rows, "a", np.uint64)
        names = _distinct(every)
        where = _finder(names)(every)
        sums = [np.bincount(where, _join(rows, c, np.uint64)).astype(np.uint64) for c in ("b", "c")]
        edges = np.append(0, np.cumsum([r["n"] for r in rows]))
        yield _record(ROOMS, [r["block"] for r in rows], [bucket] * len(rows), [r["n"] for r in rows], [None] * len(rows), *(_pieces(x[where], edges) for x in sums))
        some = (names != NONE) & (sums[0] > 0)
        for seen, x in ((CUSTOMERS_SEEN, sums[0]), (TABLES_SEEN, sums[1])):
            values, n = np.unique(x[some], return_counts=True)
            yield _record(seen, values.astype(np.int64).tolist(), [0] * len(values), n.tolist())


def _scorer(totals: Totals, common: np.ndarray, buckets: int, cell_buckets: int):
    """Last pass over cells: hash, log10 probability and the word's count, by cell's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_,), rows in _groups(batches, ("bucket",)):
            seats, words, names, _ = _seated(rows, totals, 2, common, buckets)
            own, root = seats.averaged()
            score = np.rint(-np.log10(own + backed_off(seats.totals)[seats.context] * root[seats.word]) * UNIT).astype(np.uint32)
            count = np.bincount(seats.word, seats.customers, len(seats.names)).astype(np.int64)[seats.word]
            name = _cell_names(words[seats.word], names[seats.context])
            at = _bucket(name, cell_buckets)
            order = _by(at)
            some, n = _runs(at[order])
            edges = np.append(0, np.cumsum(n, dtype=np.int64))
            yield _record(SCORED, some.tolist(), [0] * len(some), n.tolist(), *(_pieces(x[order], edges) for x in (name, score, count)))

    return run


def _asker(contexts: np.ndarray | None, buckets: int, turn: int):
    """Over (doc id, text hash, training, text): keys of blocks of documents, and the cells of each that have their turn, by cell's bucket."""

    def block(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held_out, sizes = pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        keys = (ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), hashes, np.stack([ids.is_null().to_numpy(zero_copy_only=False), held_out], 1).view(np.uint16).ravel(), sizes.astype(np.int64))
        # keys go with any bucket
        yield _record(KEYS, [number % buckets], [number], [len(sizes)], *([_planes(x)] for x in keys))
        name, doc = np.concatenate([x[4] for x in held]), np.repeat(np.arange(len(sizes)), sizes)
        at = _bucket(name, buckets)
        mine = np.flatnonzero(at % ROUNDS == turn)
        order = mine[_by(at[mine])]
        if len(order):
            some, n = _runs(at[order])
            edges = np.append(0, np.cumsum(n, dtype=np.int64))
            step = np.diff(doc[order], prepend=0)
            step[edges[:-1]] = doc[order][edges[:-1]]
            yield _record(OCCURRING, some.tolist(), [number] * len(some), n.tolist(), _pieces(name[order], edges), _pieces(step.astype(np.uint32), edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, size = [], 0
        for batch in batches:
            held_out = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            hashes = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, _, word, context, sizes in _readings(batch.column(3), contexts):
                held.append((batch.column(0).slice(a, b - a), hashes[a:b], held_out[a:b], sizes, _cell_names(word, context)))
                size += len(word)
                if size >= TOGETHER:
                    yield from block(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield from block(number, held)

    return run


def _answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored cells meet those of documents: sums by block and document of log10 probability, log10(count + 1), known words; keys as they are."""
    for (bucket,), rows in _groups(batches, ("bucket",)):
        known = [r for r in rows if r["kind"] == SCORED]
        names = _join(known, "a", np.uint64)
        order = np.argsort(names)
        names, score, count = names[order], _join(known, "b", np.uint32).astype(np.int64)[order], _join(known, "c", np.int64)[order]
        base = np.rint(np.log10(count + 1) * BASE_UNIT).astype(np.int64)
        places = _finder(names)
        for r in rows:
            if r["kind"] == KEYS:
                yield _record(KEYS, [bucket], [r["block"]], [r["n"]], *([r[c].tobytes()] for c in "abcd"))
            elif r["kind"] == OCCURRING:
                at = places(_numbers(r["a"], np.uint64))
                step = _numbers(r["b"], np.uint32)
                first = np.append(0, np.flatnonzero(step[1:]) + 1)
                sums = [np.add.reduceat(x, first) for x in (score[at], base[at], (count[at] > 0).astype(np.int64))]
                yield _record(SUMS, [bucket], [r["block"]], [len(first)], [_planes(step[first])], *([_planes(x)] for x in sums))


FOUND = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_h", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.LongType()), T.StructField("base", T.LongType()), T.StructField("known", T.LongType())])


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums that came back, by document."""
    for _, rows in _groups(batches, ("block",)):
        keys, some = next(r for r in rows if r["kind"] == KEYS), [r for r in rows if r["kind"] == SUMS]
        doc = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_numbers(r["a"], np.uint32), dtype=np.int64) for r in some)])
        sums = np.zeros((3, keys["n"]), np.int64)
        for x, c in zip(sums, "bcd", strict=True):
            np.add.at(x, doc, _join(some, c, np.int64))
        null, held_out = _numbers(keys["c"], np.uint16).view(bool).reshape(-1, 2).T
        ids = pa.array(_numbers(keys["a"], np.int64), mask=np.ascontiguousarray(null))
        yield pa.RecordBatch.from_arrays([ids, pa.array(_numbers(keys["b"], np.int64)), pa.array(np.ascontiguousarray(held_out)), pa.array(_numbers(keys["d"], np.int64)), *map(pa.array, sums)], FOUND.fieldNames())


def _frequent(rows: DataFrame, total: int, limit: int) -> list[bytes]:
    """The most frequent words of a bounded sample, and the end first: limit words at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    ppm = int(min(1.0, SAMPLE / max(total, 1)) * 1_000_000)
    sample = rows.filter(F.pmod(F.xxhash64("t", F.lit(9)), F.lit(1_000_000)) < ppm).select("t")
    counted = sample.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    found = counted.orderBy(F.desc("n"), "w").limit(limit - 1).collect()
    return list(dict.fromkeys([END, *(bytes(r["w"]) for r in found)]))


def _sweep_up(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted: Spark does so when the driver collects garbage."""
    spark.range(1).count()  # the last job is held until the next one
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents for which held_out is true are scored and not learned from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), (~held_out).alias("train"), F.col(text_col).alias("t"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = rows.count()
    buckets, cell_buckets = max(LEAST_BUCKETS, documents // TO_BUCKET), max(LEAST_CELL_BUCKETS, documents // TO_BUCKET)
    common = np.unique(np.append(_hashes(_frequent(rows, documents, COMMON)), np.array([NONE, START], np.uint64)))
    contexts = None if HEAD is None else _hashes(_frequent(rows, documents, HEAD))
    rng = np.random.default_rng(3)

    def exchanged(packed: DataFrame, *key: str) -> DataFrame:
        return packed.repartition(tasks, *key).sortWithinPartitions(*dict.fromkeys([*key, "kind", "block"]))

    cells = stored(exchanged(rows.select("train", "t").mapInArrow(_dealer(contexts, common, buckets), PACKED), "bucket").mapInArrow(_gatherer(common), PACKED), "cells")
    _sweep_up(spark)

    def with_rooms(rooms: DataFrame | None) -> DataFrame:
        """Cells, and what came back for them, by bucket."""
        return exchanged(cells.unionByName(rooms.filter(F.col("kind") == ROOMS)), "bucket") if rooms else cells

    def totals(given: Totals | None, rooms: DataFrame | None) -> tuple[Totals, DataFrame]:
        """A pass over all words, with a sweep if totals so far are given: the new totals, and those of contexts."""
        added = stored(exchanged(with_rooms(rooms).mapInArrow(_summer(given, common, buckets), PACKED), "kind", "bucket").mapInArrow(_adder, PACKED), "rooms")
        found = added.filter(F.col("kind") != ROOMS).groupBy("kind", "bucket").agg(F.sum("n").alias("n")).orderBy("kind", "bucket").collect()  # as many as there are different totals of a context
        _sweep_up(spark)
        numbers = [r["n"] for r in found if r["kind"] == TOTAL] or [0] * len(Totals().numbers())
        out = Totals()
        out.ones, (out.root_customers, out.root_tables, out.words, out.tokens) = np.array(numbers[:4], np.float64).reshape(2, 2), numbers[4:]
        seen = tuple(tuple(np.array([r[c] for r in found if r["kind"] == kind], np.float64) for c in ("bucket", "n")) for kind in (CUSTOMERS_SEEN, TABLES_SEEN))
        out.draw(rng, seen)
        return out, added

    first, rooms = totals(None, None)
    second, again = totals(first, rooms)
    forget(rooms)
    scored = stored(with_rooms(again).mapInArrow(_scorer(second, common, buckets, cell_buckets), PACKED), "scored")
    forget(cells, again)
    _sweep_up(spark)
    for turn in range(ROUNDS):
        asked = rows.mapInArrow(_asker(contexts, cell_buckets, turn), PACKED).unionByName(scored.filter(F.col("bucket") % ROUNDS == turn))
        here = exchanged(exchanged(asked, "bucket").mapInArrow(_answerer, PACKED), "block").mapInArrow(_returned, FOUND)
        if turn:
            # rows of equal id and text have equal sums
            before = found.groupBy(F.col("_id").alias("i2"), F.col("_h").alias("h2")).agg(*(F.max(c).alias(f"{c}2") for c in ("score", "base", "known")))
            both = here.join(before, F.col("_id").eqNullSafe(F.col("i2")) & (F.col("_h") == F.col("h2")))
            here = both.select("_id", "_h", "held_out", "n_tokens", *((F.col(c) + F.col(f"{c}2")).alias(c) for c in ("score", "base", "known")))
        found = stored(here, "found")
        del asked, here
        _sweep_up(spark)
    forget(scored)
    base = F.col("base") / F.lit(float(BASE_UNIT)) - F.col("n_tokens") * F.lit(float(np.log10(first.tokens + first.words + 1)))
    return found.select(F.col("_id").alias("doc_id"), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(first.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") / F.lit(float(-UNIT))).alias("score"))
