"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word's input joins a learned word vector (of its hash), the mean of learned vectors of its
character n-grams, and two log-ratios counted on the training documents: of the word, and the largest of
its character n-grams. Windows of WINDOW words, each STRIDE words after the last, cover the whole text;
the network reads a window both ways, attention pools its states into one, and a text's score is the
sigmoid of its windows' largest output. In training, the strongest of all windows of a toxic text is taught 1 (the
network looks at all of them anew every LOOK steps), and of a clean text TAUGHT windows, drawn in every step
from all of its windows, are taught 0.

Training takes a bounded sample of labelled documents and a fixed number of steps. A text without words,
and a null text, scores the base rate of the sample, below the decision threshold; so does every text if the
sample holds one label only, as nothing can be told apart then. Long texts are read whole, by windows. Equal texts give
equal scores. Unlabelled documents, null labels and null ids are not learned from; of rows that share an id, the text of
least hash is learned from. An empty table gives no rows. Other columns are kept,
those named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.batches import Vocabulary, chunks, with_columns

#: Documents to learn from by label, in expectation.
TRAIN_TOXIC, TRAIN_CLEAN = 1_500, 2_500
WINDOW, STRIDE = 48, 24
#: Windows of a clean text that are taught in one step.
TAUGHT = 5
#: Steps after which a toxic text's strongest window is sought again.
LOOK = 100
THRESHOLD = 0.7
#: Cells over which n-grams are counted, by hash.
CELLS = 1 << 20
#: Windows of training texts looked at together.
AT_A_TIME = 1024
#: Words hashed at once.
AT_ONCE = 40_000
WORD_ROWS, CHAR_ROWS, VECTOR, HIDDEN, ATTENTION = 1 << 13, 1 << 12, 6, 8, 8
STEPS, BATCH, LEARNING = 500, 48, 0.02
#: Documents that must hold a word or n-gram before its log-ratio counts.
LEAST = 4
WORD = re.compile(r"[^\W_]+")
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word; 32-bit hashes of all n-grams of 3 and 4 characters (with boundaries), word by word, and their number by word."""
    parts = [_hashes_of(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _hashes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = (np.arange(len(codes)) - starts[word]).astype(np.uint64)
    mixed = (codes + np.uint64(7)) * _MUL
    mixed ^= mixed >> np.uint64(32)
    spread = (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.add.reduceat((mixed ^ spread) * _MUL, starts)
    grams, owners = [], []
    for n in (3, 4):
        h = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + mixed[i : len(codes) - n + 1 + i]
        inside = word[: len(h)] == word[n - 1 :]
        grams.append(((h[inside] ^ (h[inside] >> np.uint64(29))) * _MUL >> np.uint64(32)).astype(np.uint32))
        owners.append(word[: len(h)][inside])
    owner = np.concatenate(owners)
    return whole ^ (whole >> np.uint64(30)), np.concatenate(grams)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def _ratios(size: int, seen: Iterator[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-ratios of document frequencies of size things, and which occur often enough; seen: things by document, one document at a time."""
    bad, good = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for things, label in zip(seen, toxic, strict=True):
        (bad if label else good)[np.unique(things)] += 1
    ratio = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
    often = bad + good >= LEAST
    return np.where(often, np.clip(ratio, -4, 8), 0).astype(np.float32), often


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters and both passes."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        inputs = 2 * VECTOR + 2
        self.p = {"word": draw(WORD_ROWS, VECTOR, scale=0.05), "char": draw(CHAR_ROWS, VECTOR, scale=0.05), "Wa": draw(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": draw(ATTENTION), "w": draw(2 * HIDDEN), "b": np.float32([-2.0])}
        for d in "fb":
            self.p |= {f"W{d}": draw(inputs, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": draw(HIDDEN, 3 * HIDDEN)}
        self.word_keys, self.word_ratio = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self.char_ratio = np.zeros(CELLS, np.float32)
        self.rate, self.taught = 0.0, False

    def features(self, words: list[str]) -> dict:
        """What a word's input is made of: hashes, rows of vectors and log-ratios."""
        whole, grams, count = _hashes(words)
        first = np.cumsum(count) - count
        ratio = self.char_ratio[grams % np.uint32(CELLS)]
        return {
            "word": (whole % np.uint64(WORD_ROWS)).astype(np.int32), "grams": (grams % np.uint32(CHAR_ROWS)).astype(np.int32), "first": first, "count": count,
            "fixed": np.stack([_look(self.word_keys, self.word_ratio, whole), np.maximum.reduceat(ratio, first)], 1) * np.float32(0.5),
        }

    def inputs(self, f: dict) -> np.ndarray:
        char = np.add.reduceat(self.p["char"][f["grams"]], f["first"]) / f["count"][:, None].astype(np.float32)
        return np.concatenate([self.p["word"][f["word"]], char, f["fixed"]], 1)

    def project(self, f: dict) -> np.ndarray:
        """Both directions' input terms of each word: worked out once for each distinct word."""
        x = self.inputs(f)
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], 1)

    def forward(self, terms: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows. terms: step, window, both directions' input terms; mask: step, window, 1 where a word is."""
        steps, n, k = terms.shape[0], terms.shape[1], HIDDEN
        states = np.zeros((steps, n, 2 * k), np.float32)
        for d, (u, times, side) in enumerate(((self.p["Uf"], range(steps), 0), (self.p["Ub"], range(steps - 1, -1, -1), 3 * k))):
            h = np.zeros((n, k), np.float32)
            for t in times:
                x, m = terms[t, :, side : side + 3 * k], mask[t][:, None]
                a = h @ u
                gates = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
                z, r = gates[:, :k], gates[:, k:]
                c = np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :])
                new = c + z * (h - c)
                if trace is not None:
                    trace[d, t] = (h, z, r, c, a[:, 2 * k :])
                h = h + m * (new - h)
                states[t, :, d * k : d * k + k] = h
        hidden = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        energy = np.where(mask > 0, hidden @ self.p["va"], np.float32(-1e9))
        share = np.exp(energy - energy.max(0))
        share /= share.sum(0)
        pooled = (share[:, :, None] * states).sum(0)
        if trace is not None:
            trace |= {"states": states, "hidden": hidden, "share": share, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def backward(self, slope: np.ndarray, terms: np.ndarray, mask: np.ndarray, trace: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the input, and of terms; slope: of the logits."""
        steps, n, k = terms.shape[0], terms.shape[1], HIDDEN
        states, hidden, share = trace["states"], trace["hidden"], trace["share"]
        g = {"w": trace["pooled"].T @ slope, "b": np.float32([slope.sum()])}
        pooled = slope[:, None] * self.p["w"]
        down = share[:, :, None] * pooled
        part = (states * pooled).sum(2)
        energy = share * (part - (share * part).sum(0))
        inner = energy[:, :, None] * self.p["va"] * (1 - hidden**2)
        g |= {"va": np.tensordot(energy, hidden, ((0, 1), (0, 1))), "Wa": np.tensordot(states, inner, ((0, 1), (0, 1))), "ba": inner.sum((0, 1))}
        down = down + inner @ self.p["Wa"].T
        out = np.zeros_like(terms)
        for d, (name, times, side) in enumerate((("Uf", range(steps - 1, -1, -1), 0), ("Ub", range(steps), 3 * k))):
            u, gu, carry = self.p[name], np.zeros_like(self.p[name]), np.zeros((n, k), np.float32)
            for t in times:
                h, z, r, c, an = trace[d, t]
                total = down[t, :, d * k : d * k + k] + carry
                m = mask[t][:, None]
                new = m * total
                dc = new * (1 - z) * (1 - c * c)
                dz = new * (h - c) * z * (1 - z)
                dr = dc * an * r * (1 - r)
                out[t, :, side : side + 3 * k] = x = np.concatenate([dz, dr, dc], 1)
                da = np.concatenate([dz, dr, dc * r], 1)
                gu += h.T @ da
                carry = total - new + new * z + da @ u.T
                del x
            g[name] = gu
        return g, out


def _windows(numbers: np.ndarray) -> np.ndarray:
    """Starts of the windows that cover a text of that many words; numbers: texts' lengths. Rows: text, start."""
    count = 1 + np.maximum(0, -(-(numbers - WINDOW) // STRIDE))
    count[numbers == 0] = 0
    text = np.repeat(np.arange(len(numbers)), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return np.stack([text, start], 1)


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Network:
    """A network taught on texts with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    net = Network(seed)
    toxic = np.asarray(toxic, np.float64)
    net.rate = float((toxic.sum() + 1) / (len(toxic) + 2))
    known = Vocabulary()
    ids = [known.numbers(WORD.findall(t.lower())).astype(np.int32) for t in texts]
    if not len(known) or not 0 < toxic.sum() < len(toxic):
        return net
    words = known.take_fresh()
    whole, grams, count = _hashes(words)
    cells = (grams % np.uint32(CELLS)).astype(np.int32)
    first = np.append(0, np.cumsum(count))
    del grams

    def inside(x: np.ndarray) -> np.ndarray:
        x = np.unique(x)
        return cells[np.repeat(first[x] - (np.cumsum(count[x]) - count[x]), count[x]) + np.arange(count[x].sum())]

    ratio, often = _ratios(len(words), iter(ids), toxic)
    order = np.flatnonzero(often)[np.argsort(whole[often])]
    net.word_keys, net.word_ratio = whole[order], ratio[order]
    net.char_ratio, _ = _ratios(CELLS, map(inside, ids), toxic)
    del whole, cells, first, count
    f = net.features(words)
    windows = [_windows(np.array([len(x)]))[:, 1] for x in ids]  # of each text, starts
    usable = np.flatnonzero([len(w) > 0 for w in windows])
    bad, good = usable[toxic[usable] == 1], usable[toxic[usable] == 0]
    if not len(bad) or not len(good):
        return net
    net.taught = True

    def laid(rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and mask of windows (text, start)."""
        filled, mask = np.zeros((WINDOW, len(rows)), np.int64), np.zeros((WINDOW, len(rows)), np.float32)
        for c, (j, s) in enumerate(rows):
            part = ids[j][s : s + WINDOW]
            filled[: len(part), c], mask[: len(part), c] = part, 1
        return filled, mask

    def terms_of(filled: np.ndarray) -> tuple:
        used, back = np.unique(filled, return_inverse=True)
        own = _rows_of(f, used)
        x = net.inputs(own)
        back = back.reshape(filled.shape)
        return used, back, own, x, np.concatenate([x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"]], 1)[back]

    def outputs(texts: list[int]) -> list[np.ndarray]:
        """Logits of all windows of texts."""
        every = [(j, s) for j in texts for s in windows[j]]
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(every), AT_A_TIME):
            filled, mask = laid(every[i : i + AT_A_TIME])
            out.append(net.forward(terms_of(filled)[-1], mask))
        return np.split(np.concatenate(out), np.cumsum([len(windows[j]) for j in texts])[:-1]) if texts else []

    strongest: dict[int, int] = {}
    looked: dict[int, int] = {}
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    share = int(np.clip(round(BATCH * len(bad) / len(usable)), BATCH // 6, BATCH // 2))
    weight = len(bad) / len(usable) / (share / BATCH)  # of toxic texts, so that scores keep the sample's base rate
    for step in range(1, STEPS + 1):
        chosen = np.concatenate([rng.choice(bad, share), rng.choice(good, BATCH - share)])
        stale = [j for j in dict.fromkeys(chosen.tolist()) if toxic[j] and len(windows[j]) > 1 and step - looked.get(j, -LOOK) >= LOOK]
        for j, seen in zip(stale, outputs(stale), strict=True):
            strongest[j], looked[j] = int(seen.argmax()), step
        rows, owners = [], []
        for i, j in enumerate(chosen.tolist()):
            count = len(windows[j])
            drawn = [strongest.get(j, 0)] if toxic[j] else rng.choice(count, min(TAUGHT, count), replace=False).tolist()
            rows += [(j, windows[j][w]) for w in drawn]
            owners += [i] * len(drawn)
        filled, mask = laid(rows)
        used, back, own, x, terms = terms_of(filled)
        trace: dict = {}
        logits = net.forward(terms, mask, trace)
        p = 1 / (1 + np.exp(-logits.astype(np.float64)))
        owner = np.array(owners)
        top = np.full(len(chosen), -np.inf)
        np.maximum.at(top, owner, logits)
        part = np.where(logits == top[owner], 1.0, 1 / np.bincount(owner)[owner])
        slope = np.where(toxic[chosen][owner] == 1, (p - 1) * weight, p * part).astype(np.float32)
        g, dterms = net.backward(slope / BATCH, terms, mask, trace)
        flat = np.zeros((len(used), dterms.shape[2]), np.float32)
        np.add.at(flat, back.ravel(), dterms.reshape(-1, dterms.shape[2]))
        k = 3 * HIDDEN
        g |= {"Wf": x.T @ flat[:, :k], "Wb": x.T @ flat[:, k:], "cf": flat[:, :k].sum(0), "cb": flat[:, k:].sum(0)}
        dx = flat[:, :k] @ net.p["Wf"].T + flat[:, k:] @ net.p["Wb"].T
        g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
        np.add.at(g["word"], own["word"], dx[:, :VECTOR])
        np.add.at(g["char"], own["grams"], np.repeat(dx[:, VECTOR : 2 * VECTOR] / own["count"][:, None], own["count"], 0))
        rate = LEARNING * min(1.0, step / 20) * (1 - 0.9 * step / STEPS)
        for name, value in net.p.items():
            slow = 0.2 if name in ("word", "char") else 1.0
            mean[name] = 0.9 * mean[name] + 0.1 * g[name]
            second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
            net.p[name] = (value - slow * rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _rows_of(f: dict, used: np.ndarray) -> dict:
    """The features of some words."""
    count = f["count"][used]
    where = np.repeat(f["first"][used] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return {"word": f["word"][used], "grams": f["grams"][where], "first": np.cumsum(count) - count, "count": count, "fixed": f["fixed"][used]}


class Scorer:
    """Scores of texts, remembering words' input terms."""

    AT_ONCE = 4096

    def __init__(self, net: Network) -> None:
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.known = Vocabulary()
        self.terms = np.zeros((0, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), min(self.net.rate, THRESHOLD / 2))
        if not self.net.taught:
            return out
        for a, b in chunks(texts):
            kept = self.known.shrink()
            if kept is not None:
                self.terms = self.terms[kept]
            ids = [self.known.numbers(WORD.findall(t.lower())) if t else np.zeros(0, np.int64) for t in texts[a:b]]
            fresh = self.known.take_fresh()
            if fresh:
                self.terms = np.concatenate([self.terms, self.net.project(self.net.features(fresh))])
            sizes = np.array([len(x) for x in ids])
            if not sizes.sum():
                continue
            flat = np.concatenate(ids)
            self.known.used(flat)
            begin = np.cumsum(sizes) - sizes
            windows = _windows(sizes)
            logits = np.zeros(len(windows))
            length = np.minimum(sizes[windows[:, 0]] - windows[:, 1], WINDOW)
            order = np.argsort(length, kind="stable")
            for i in range(0, len(order), self.AT_ONCE):
                some = order[i : i + self.AT_ONCE]
                size = length[some]
                steps = np.arange(size.max())[:, None]
                mask = (steps < size).astype(np.float32)
                where = np.minimum(begin[windows[some, 0]] + windows[some, 1] + steps, len(flat) - 1)
                logits[some] = self.net.forward(self.terms[flat[where]], mask)
            best = np.full(b - a, -np.inf)
            np.maximum.at(best, windows[:, 0], logits)
            full = np.flatnonzero(sizes)
            out[a + full] = 1 / (1 + np.exp(-best[full]))
        return out

    def columns(self, texts: list[str | None]) -> list:
        scores = self.scores(texts)
        return [scores, (scores >= THRESHOLD).astype(np.int32)]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network taught on a hashed sample of the documents with a label; labels of one id must agree, else the larger counts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ppm = {y: int(min(1.0, most / max(sizes.get(y, 0), 1)) * 1_000_000) for y, most in ((0, TRAIN_CLEAN), (1, TRAIN_TOXIC))}
    sampled = known.filter(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1_000_000)) < F.when(F.col("y") == 1, ppm[1]).otherwise(ppm[0]))
    # the sample is bounded, so it may be broadcast and what it joins may be gathered
    found = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(sampled), docs[id_col] == F.col("i")).select("i", "y", F.struct(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t")).alias("x"))
    rows = found.groupBy("i", "y").agg(F.min("x").alias("x")).select("i", "y", "x.t").collect()
    rows.sort(key=lambda r: (r["i"], r["t"]))
    return fit([r["t"] for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by its shape and its sample
    return with_columns(docs, text_col, FIELDS, lambda: Scorer(shared.value).columns, keep)
