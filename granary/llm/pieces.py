"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into machines of states and arcs. The normaliser rewrites characters by the model's
character map, longest match first, and leaves user-defined symbols as they are; white space is then squeezed,
marked, and given a mark in front, as the model says. The pieces are a trie of arcs labelled with characters,
whose final states put out a piece. Byte fallback accepts any one character and puts out the pieces of its bytes,
or the unknown piece. An input is composed with them state by state, and the shortest path in the tropical
semiring (weights added along a path, the least sum taken) is put out.

For a unigram model an arc weighs the negated score. For a byte-pair model the arc from one piece to the next
weighs 0 where the two may stand side by side, that is where merging their joined text by rank would leave the
boundary between them, and infinity elsewhere; a state of the composition is a position and the last piece. One
path has a finite weight, the one that merging gives, so each position keeps the only last piece of finite
weight, and the search is linear in the text whatever its length.

Texts are cut where no piece crosses, so worked-out chunks are remembered. A null text gives no pieces; so does
an empty one; long texts are read whole. Decoding gives back the normalised text; null ids give a null text. Equal
texts give equal results, rows of one id with different texts each their own; an empty table gives no rows. Other
columns are kept, those named like the results are replaced. Models with a map for decoding are refused.

Ids are those of the usual library for byte-pair models. For unigram models the library adds weights in single precision
over a whole text, so in long texts it may take a path that is longer by less than its rounding; here the shortest one is taken.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.batches import MEMORY, Vocabulary, chunks, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0]
            at += size


class Machine:
    """A transducer: arcs[state][character] leads to a state, out[state] is what a final state puts out."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.out: list = [None]

    def add(self, key: str, out: object) -> None:
        state = 0
        for c in key:
            to = self.arcs[state].get(c)
            if to is None:
                to = self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
                self.out.append(None)
            state = to
        self.out[state] = out

    def longest(self, text: str, at: int) -> tuple[int, object] | None:
        """Where the longest accepted part of text from at ends, and what it puts out."""
        state, found = 0, None
        for i in range(at, len(text)):
            to = self.arcs[state].get(text[i])
            if to is None:
                break
            state = to
            if self.out[state] is not None:
                found = i + 1, self.out[state]
        return found


def character_map(blob: bytes) -> dict[str, str]:
    """What a compiled character map rewrites: its double array of bytes is walked whole. Layout: size of the array, the array, replacements that end in a zero byte."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, np.uint32, size // 4, 4).astype(np.int64), blob[4 + size :]
    labels = np.arange(1, 256)
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    found, todo = {}, [(int(offset(units[0])), b"")]
    while todo:
        place, key = todo.pop()
        there = place ^ labels
        inside = there < len(units)
        for c in labels[inside][(units[there[inside]] & 0x800000FF) == labels[inside]].tolist():
            unit = int(units[place ^ c])
            following = (place ^ c) ^ offset(unit)
            if unit >> 8 & 1:
                begin = int(units[following]) & 0x7FFFFFFF
                found[(key + bytes([c])).decode("utf-8", "surrogateescape")] = texts[begin : texts.index(b"\0", begin)].decode()
            todo.append((following, key + bytes([c])))
    return found


class Transducer:
    """A compiled model file."""

    def __init__(self, model: bytes) -> None:
        self.texts: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.prefix = self.squeeze = escape = True
        self.kind, self.suffix, charmap, surface = UNIGRAM, False, b"", " \u2047 ".encode()
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.texts.append(piece[1].decode())
                scores.append(piece[2])
                self.kinds.append(piece[3])
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.suffix, surface = spec.get(3, UNIGRAM), bool(spec.get(24, 0)), spec.get(44, surface)
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, self.squeeze, escape, charmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), spec.get(2, b"")
            elif number == 5 and dict(_fields(value)).get(2):
                raise ValueError("a model with a character map for decoding")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a byte-pair model")
        self.mark = MARK if escape else " "
        kinds = (NORMAL, USER, UNUSED) if self.kind == BPE else (NORMAL, USER)
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in kinds and t}
        self.weight = {t: -scores[i] for t, i in self.ids.items()}
        self.bytes = {int(t[3:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.users = [t for t in self.ids if self.kinds[self.ids[t]] == USER]
        self.output = [b"" if k == CONTROL else bytes([int(t[3:-1], 16)]) if k == BYTE else surface if k == UNKNOWN else t.replace(MARK, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        self._compile_normaliser(character_map(charmap))
        self._compile_pieces()

    def _compile_normaliser(self, rewritten: dict[str, str]) -> None:
        self.normaliser = Machine()
        for key, to in rewritten.items():
            self.normaliser.add(key, to)
        self.kept = Machine()
        for t in self.users:
            self.kept.add(t.replace(self.mark, " "), t)
        first = sorted({*self.normaliser.arcs[0], *self.kept.arcs[0]})
        self.touched = re.compile("[" + "".join(map(re.escape, first)) + "]") if first else None

    def _compile_pieces(self) -> None:
        self.pieces = Machine()
        frozen = set(self.users) if self.kind == BPE else set()
        for t in self.ids:
            if t not in frozen:
                self.pieces.add(t, t)
        plain = [t for t in self.ids if t not in frozen]
        crosses = any(re.search(f"[^{self.mark}]{self.mark}", t) for t in plain)
        alone = not any("\n" in t for t in plain)
        m = self.mark
        cut = "(?s:.+)" if crosses else f"{m}+[^{m}\n]*|[^{m}\n]+|\n+" if alone else f"{m}+[^{m}]*|[^{m}]+"
        self.cut = re.compile(cut)
        # in a byte-pair model user-defined symbols never merge, so texts are cut around them
        self.frozen = re.compile("(" + "|".join(map(re.escape, sorted(frozen, key=len, reverse=True))) + ")") if frozen else None
        self.spines: dict[str, tuple] = {}
        self.allowed: dict[tuple[str, str], bool] = {}
        if self.kind == BPE:
            self.parts = {t: self._last_merge(t) for t in plain if len(t) > 1}
        else:
            normal = [-self.weight[t] for t in plain if self.kinds[self.ids[t]] == NORMAL]
            most, least = max(normal, default=0.0), min(normal, default=0.0)
            self.scores = {t: float(len(t.encode()) * most - 0.1) if self.kinds[self.ids[t]] == USER else -self.weight[t] for t in plain}
            self.fallback = float(least) - 10

    # --- the weights of a byte-pair model -------------------------------------------------------

    def _last_merge(self, text: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to make a piece; None if merging never makes it."""
        parts = list(text)
        while len(parts) > 2:
            ranks = [self.weight.get(a + b, math.inf) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == math.inf:
                return None
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _spine(self, text: str, side: int) -> tuple:
        """(symbol, made at, used at) along one edge of a piece, from its outermost character up to itself."""
        found = self.spines.get((text, side))
        if found is None:
            steps, used = [], math.inf
            while True:
                parts = self.parts.get(text) if len(text) > 1 else None
                made = self.weight[text] if parts else -math.inf
                steps.append((text, made, used))
                if not parts:
                    break
                text, used = parts[side], made
            found = self.spines[(steps[0][0], side)] = tuple(reversed(steps))
        return found

    def beside(self, left: str, right: str) -> bool:
        """Whether the arc from left to right has weight 0.

        It has not if some symbols x at left's inner edge and y at right's exist at the same time
        and join to a piece of a rank before both are used; of equal ranks the one farther left goes first.
        """
        key = (left, right)
        found = self.allowed.get(key)
        if found is None:
            xs, ys = self._spine(left, 1), self._spine(right, 0)
            i = j = 0
            found = True
            while True:
                x, _, used_x = xs[i]
                y, _, used_y = ys[j]
                rank = self.weight.get(x + y)
                if rank is not None and rank < used_x and rank <= used_y:
                    found = False
                    break
                if used_x == used_y == math.inf:
                    break
                if used_x <= used_y:
                    i += 1
                if used_y <= used_x:
                    j += 1
            if len(self.allowed) > MEMORY:
                self.allowed.clear()
            self.allowed[key] = found
        return found

    # --- composition and shortest path -----------------------------------------------------------

    def _path_bpe(self, text: str) -> list[str]:
        """Pieces, and single characters that are none, of the path of weight 0."""
        last = [""] * (len(text) + 1)
        arcs, out, parts, allowed, beside = self.pieces.arcs, self.pieces.out, self.parts, self.allowed, self.beside
        size = len(text)
        for begin in range(size):
            before = last[begin]
            if begin and not before:
                continue
            state, end = 0, begin
            while end < size:
                state = arcs[state].get(text[end])
                end += 1
                if state is None:
                    if end - begin > 1:
                        break
                    piece = text[begin]  # byte fallback
                else:
                    piece = out[state]
                    if piece is None:
                        if end - begin > 1:
                            continue
                        piece = text[begin]
                    elif end - begin > 1 and not parts[piece]:
                        continue
                if not last[end] and (not begin or (allowed[key] if (key := (before, piece)) in allowed else beside(before, piece))):
                    last[end] = piece
                if state is None:
                    break
        path, end = [], size
        while end:
            path.append(last[end])
            end -= len(last[end])
        return path[::-1]

    def _path_unigram(self, text: str) -> list[str]:
        """Pieces, and single characters that are none, of the path of least weight; of equal ones the one whose last piece begins first."""
        size = len(text)
        best: list = [0.0] + [None] * size
        back = [0] * (size + 1)
        arcs, out = self.pieces.arcs, self.pieces.out
        for begin in range(size):
            state, alone = 0, False
            for end in range(begin + 1, size + 1):
                state = arcs[state].get(text[end - 1])
                if state is None:
                    break
                if out[state] is not None:
                    score = best[begin] + self.scores[out[state]]
                    alone |= end == begin + 1
                    if best[end] is None or score > best[end]:
                        best[end], back[end] = score, begin
            if not alone:
                score = best[begin] + self.fallback
                if best[begin + 1] is None or score > best[begin + 1]:
                    best[begin + 1], back[begin + 1] = score, begin
        path, end = [], size
        while end:
            path.append(text[back[end] : end])
            end = back[end]
        return path[::-1]

    def _used(self, piece: str) -> list[str]:
        """A piece that is marked as unused falls into the parts that it was merged from."""
        known = self.ids.get(piece)
        if self.kind != BPE or known is None or self.kinds[known] != UNUSED or not self.parts.get(piece):
            return [piece]
        return [x for part in self.parts[piece] for x in self._used(part)]

    def chunk(self, text: str) -> list[int]:
        """Ids of a normalised chunk."""
        whole = self.ids.get(text)
        if whole is not None and self.kinds[whole] != UNUSED and (self.frozen and text in self.users or self.kind == BPE and (len(text) == 1 or self.parts[text])):
            return [whole]
        out: list[int] = []
        for found in self._path_bpe(text) if self.kind == BPE else self._path_unigram(text):
            for piece in self._used(found):
                known = self.ids.get(piece)
                if known is not None:
                    out.append(known)
                elif self.bytes:
                    out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
                else:
                    out.append(self.unknown)
        return out

    def normalise(self, text: str) -> str:
        if self.touched is not None:
            text = self._rewritten(text)
        if self.squeeze:
            text = re.sub("  +", " ", text).strip(" ")
        if not text:
            return ""
        text = text.replace(" ", self.mark)
        if self.squeeze:
            text = text.rstrip(self.mark)
        if not self.prefix:
            return text
        return text + self.mark if self.suffix else self.mark + text

    def _rewritten(self, text: str) -> str:
        """text composed with the normaliser; only places where one of its arcs begins are looked at."""
        out, at = [], 0
        found = self.touched.search(text)
        while found:
            i = found.start()
            out.append(text[at:i])
            accepted = self.kept.longest(text, i) or self.normaliser.longest(text, i)
            at, put = accepted or (i + 1, text[i])
            out.append(put)
            found = self.touched.search(text, at)
        out.append(text[at:])
        return "".join(out)

    def chunks_of(self, text: str) -> list[str]:
        """A normalised text, cut where no piece crosses."""
        if self.frozen is None:
            return self.cut.findall(text)
        out = []
        for i, part in enumerate(self.frozen.split(text)):
            out += [part] if i % 2 else self.cut.findall(part)
        return out

    def collapsed(self, ids: np.ndarray) -> np.ndarray:
        """A run of unknown pieces is one."""
        if self.bytes or len(ids) < 2:
            return ids
        unknown = ids == self.unknown
        return ids[np.append(True, ~(unknown[1:] & unknown[:-1]))]

    def encode(self, text: str) -> list[int]:
        ids = [i for part in self.chunks_of(self.normalise(text)) for i in self.chunk(part)]
        return self.collapsed(np.array(ids, np.int32)).tolist()

    def shown(self, normal: str) -> str:
        """A normalised text as decoding gives it back: marks are blanks, the mark put first (or last) is gone."""
        text = normal.replace(MARK, " ")
        if self.prefix and self.suffix:
            return text.removesuffix(" ")
        return text.removeprefix(" ") if self.prefix or self.squeeze else text

    def decode(self, ids: list[int]) -> str:
        return self.shown(b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace"))

    def spells(self, chunk: str, ids: list[int]) -> bool:
        """Whether the pieces of a chunk decode to it."""
        return b"".join(map(self.output.__getitem__, ids)) == chunk.replace(MARK, " ").encode("utf-8", "surrogatepass")


class Encoder:
    """Encoding of many texts, remembering chunks."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine
        self.reset()

    def reset(self) -> None:
        self.known = Vocabulary()
        self.flat, self.begin, self.spelt = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _shrink(self) -> None:
        kept = self.known.shrink()
        if kept is not None:
            length = self.begin[kept + 1] - self.begin[kept]
            end = np.cumsum(length)
            self.flat = self.flat[np.repeat(self.begin[kept] - (end - length), length) + np.arange(length.sum())]
            self.begin, self.spelt = np.append(0, end), self.spelt[kept]

    def _learn(self) -> None:
        fresh = self.known.take_fresh()
        if fresh:
            found = [self.machine.chunk(x) for x in fresh]
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in found])])
            self.spelt = np.concatenate([self.spelt, [self.machine.spells(x, ids) for x, ids in zip(fresh, found, strict=True)]])

    def columns(self, texts: list[str | None]) -> list:
        """ids as an Arrow list array, the number of pieces, and whether decoding gives the normalised text back (it does where all of its chunks are spelt by their pieces, as no character crosses chunks)."""
        values, sizes, same = [], [], []
        for a, b in chunks(texts):
            self._shrink()
            numbers = [self.known.numbers(self.machine.chunks_of(self.machine.normalise(t))) if t else np.zeros(0, np.int64) for t in texts[a:b]]
            self._learn()
            self.known.used(np.concatenate(numbers))
            for n in numbers:
                length = self.begin[n + 1] - self.begin[n]
                total = int(length.sum())
                where = np.repeat(self.begin[n] - (np.cumsum(length) - length), length) + np.arange(total)
                ids = self.machine.collapsed(self.flat[where])
                same.append(bool(self.spelt[n].all()))
                values.append(ids)
                sizes.append(len(ids))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32))), np.array(sizes, np.int64), np.array(same, bool)]


def load(path: str = MODEL) -> Transducer:
    with open(path, "rb") as file:
        return Transducer(file.read())


def encode(docs: DataFrame, machine: Transducer, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with ids, n_pieces and round_trip."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the model file
    return with_columns(docs, text_col, FIELDS, lambda: Encoder(shared.value).columns, keep)


def decode(encoded: DataFrame, machine: Transducer, ids_col: str = "ids") -> DataFrame:
    """encoded with text, from ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(machine)
    fields = T.StructType([T.StructField("text", T.StringType())])
    return with_columns(encoded, ids_col, fields, lambda: lambda rows: [[None if r is None else shared.value.decode(r) for r in rows]])
