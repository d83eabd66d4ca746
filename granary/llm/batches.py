"""Arrow-batch plumbing for the operators that run Python on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Distinct words a worker remembers; beyond them, it keeps the most used half.
MEMORY = 400_000
#: Characters of text worked on at once.
CHUNK = 4_000_000


class Vocabulary(dict):
    """word -> number, numbered as they come; fresh holds the words of numbers not yet worked out."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.uses = np.zeros(0)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def used(self, numbers: np.ndarray) -> None:
        """Note what has been used."""
        count = np.bincount(numbers, minlength=len(self)).astype(np.float64)
        count[: len(self.uses)] += self.uses
        self.uses = count

    def shrink(self) -> np.ndarray | None:
        """If it has outgrown MEMORY, keep the most used half, newly numbered; gives the old numbers of what is kept."""
        if len(self) <= MEMORY:
            return None
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: MEMORY // 2])
        words = list(self)
        self.clear()
        self.update((words[i], k) for k, i in enumerate(kept.tolist()))
        self.uses = self.uses[kept] / 2
        return kept

    def take_fresh(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters each; a longer text is a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted batches by their first keys columns (of whole numbers), each group in one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)], 1)
        edges = np.append(np.append(0, np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1), len(names)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(names[a])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def with_columns(df: DataFrame, text_col: str, added: T.StructType, start: Callable[[], Callable[[list], list]], keep: list[str] | None = None, where: str | None = None) -> DataFrame:
    """df's columns (or those in keep) and the added ones, which start()(texts) gives as lists or arrays, one for each field.

    start runs once for each task. Columns of df that clash with added names are replaced. With
    where, only rows whose added boolean column of that name is false stay, and it is dropped.
    """
    names = [c for c in (keep or df.columns) if c not in added.names]
    source = df.select(*dict.fromkeys([*names, text_col]))
    fields = [df.schema[c] for c in names] + [f for f in added.fields if f.name != where]
    types = {f.name: pa_type(f.dataType) for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            got = dict(zip(added.names, work(batch.column(batch.schema.get_field_index(text_col)).to_pylist()), strict=True))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names] + [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], types[f.name]) for f in added.fields if f.name != where]
            out = pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])
            yield out.filter(pa.array(~np.asarray(got[where], bool))) if where else out

    return source.mapInArrow(run, T.StructType(fields))


def pa_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa_type(kind.elementType))
    return {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "float": pa.float32()}[kind.simpleString()]
