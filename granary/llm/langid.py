"""Language identification by interpolated Kneser-Ney character models, one for each language.

Models see words (runs of letters, folded) between boundaries. Each order's n-grams are 64-bit hashes
in one sorted array; beside it stand, for each language, the interpolated log-probability of the
n-gram and the log backoff weight of the n-gram as a context. A text's language is the one of lowest
cross-entropy per character. A text is rejected if it has no letter, or if its lowest cross-entropy
lies farther above the language's usual one than calibration texts do, allowing for its length. Every character of a
text counts towards its cross-entropy; as evidence, in the score and in that allowance, a text of more than LONG characters counts as one
of LONG, since the characters of one text are not independent of each other.

A null text, or one without letters, gives und, score 0 and rejected. Rows with a null language are
not learned from. Equal texts give equal results; languages of equal cross-entropy are taken in order
of name. Rows of one id are judged each by its own text. An empty table gives no rows. Other columns are kept, those named like the results are replaced. Without any labelled row
every text gives und.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.batches import Vocabulary, chunks, with_columns
from granary.llm.common import stored

ORDER = 5
#: Distinct texts to learn from, over all languages: a classifier's bounded sample.
TRAIN_DOCS = 2_000
#: One in so many of each language's sampled texts calibrates instead of counting.
CALIBRATE = 4
#: Times the largest deviation seen in calibration that is still accepted.
SLACK = 1.5
LONG = 400
UND = "und"
WORD = re.compile(r"[^\W\d_]+")
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
_P = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes by order of the n-grams that end at each predicted character (0: none), its word, and its distance from the boundary."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(codes)) - starts[word]
    keep = depth > 0
    mixed = (codes * _P) ^ (codes * _P >> np.uint64(29))
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[n - 1 :] = mixed[: max(len(codes) - n + 1, 0)]
        # h covers characters i-n+1 .. i; the farther ones are multiplied more often
        h = h + shifted * np.uint64(pow(0x100000001B3, n - 1, 1 << 64))
        g = (h ^ (h >> np.uint64(31))) * _P + np.uint64(n)
        out.append(np.where(depth >= n - 1, g, np.uint64(0)))
    return [g[keep] for g in out], word[keep], depth[keep]


def _context(words: list[str]) -> list[np.ndarray]:
    """For each predicted character the hashes by order of the n-grams that end just before it (the boundary counts)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    g, _, depth = grams(words)
    boundary = grams([" "])[0][0][-1]
    out = []
    for n in range(ORDER):
        before = np.zeros(len(depth), np.uint64)
        before[1:] = g[n][:-1]
        before[depth == 1] = boundary if n == 0 else 0
        out.append(before)
    assert len(depth) == sizes.sum() - len(words)
    return out


class Model:
    """keys[n]: sorted hashes of (n+1)-grams; logp[n], gamma[n]: a row for each key, a column for each language."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        self.langs = sorted(counts)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.gamma: list[np.ndarray] = []
        per = []
        for lang in self.langs:
            words = list(counts[lang])
            n = np.array([counts[lang][w] for w in words], np.float64)
            g, word, depth = grams(words)
            per.append((g, _context(words), n[word], depth.astype(np.int32)))
        alphabet = len({c for lang in self.langs for w in counts[lang] for c in w}) + 2
        self.unknown = np.zeros(len(self.langs))
        for k in range(ORDER):
            stats = []
            for g, ctx, weight, depth in per:
                here = g[k] != 0
                keys, first, inverse = np.unique(g[k][here], return_index=True, return_inverse=True)
                raw = np.bincount(inverse, weight[here], len(keys))
                at_start = depth[here][first] == k  # begins at the boundary: nothing can precede it
                suffix = g[k - 1][here][first] if k else np.zeros(len(keys), np.uint64)
                context = ctx[k - 1][here][first] if k else np.zeros(len(keys), np.uint64)
                if k < ORDER - 1:
                    longer = g[k + 1] != 0
                    _, rep = np.unique(g[k + 1][longer], return_index=True)
                    left = np.bincount(np.searchsorted(keys, g[k][longer][rep]), minlength=len(keys)).astype(np.float64)
                    count = np.where(at_start & (k > 0), raw, np.maximum(left, 1))
                else:
                    count = raw
                stats.append((keys, count, context, suffix))
            union, rep = np.unique(np.concatenate([s[0] for s in stats]), return_index=True)
            context, suffix = np.concatenate([s[2] for s in stats])[rep], np.concatenate([s[3] for s in stats])[rep]
            logp, gamma = np.zeros((len(union), len(self.langs)), np.float32), np.zeros((len(self.keys[k - 1]) if k else 1, len(self.langs)), np.float32)
            for j, (keys, count, own, _) in enumerate(stats):
                n1, n2 = (count == 1).sum(), (count == 2).sum()
                discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                where = np.searchsorted(self.keys[k - 1], own) if k else np.zeros(len(keys), np.int64)
                total = np.bincount(where, count, len(gamma))
                kinds = np.bincount(where, minlength=len(gamma))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
                gamma[:, j] = np.log(weight)
                if k:
                    lower = self.logp[k - 1][np.searchsorted(self.keys[k - 1], suffix), j]
                    back = gamma[np.searchsorted(self.keys[k - 1], context), j] + lower
                else:
                    self.unknown[j] = gamma[0, j] - np.log(alphabet)
                    back = np.full(len(union), self.unknown[j])
                mine = np.searchsorted(union, keys)
                p = np.exp(back)
                p[mine] += np.maximum(count - discount, 0) / total[where]
                logp[:, j] = np.log(p)
            self.keys.append(union)
            self.logp.append(logp)
            self.gamma.append(gamma)
        self.usual: dict = {}
        self.kappa = 0.1

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word by language; words without letters must not come here."""
        g, word, _ = grams(words)
        before = _context(words)
        total = np.broadcast_to(self.unknown, (len(word), len(self.langs))).astype(np.float32)
        for k in range(ORDER):
            keys = self.keys[k]
            at = np.minimum(np.searchsorted(keys, g[k]), len(keys) - 1)
            found = keys[at] == g[k]
            if k:
                ctx = np.minimum(np.searchsorted(self.keys[k - 1], before[k - 1]), len(self.keys[k - 1]) - 1)
                known = (self.keys[k - 1][ctx] == before[k - 1])[:, None]
                total = total + np.where(known & (g[k] != 0)[:, None], self.gamma[k][ctx], 0)
            total[found] = self.logp[k][at[found]]
        return np.stack([np.bincount(word, total[:, j], len(words)) for j in range(len(self.langs))], 1)


class Scorer:
    """Cross-entropies of texts, remembering words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.words, self.rows = Vocabulary(), np.zeros((0, len(self.model.langs) + 1))

    def _learn(self) -> None:
        fresh = self.words.take_fresh()
        if fresh:
            rows = np.zeros((len(fresh), self.rows.shape[1]))
            real = [i for i, w in enumerate(fresh) if any(map(str.isalpha, w))]
            if real:
                rows[real, :-1] = self.model.score([fresh[i] for i in real])
                rows[real, -1] = [len(fresh[i]) + 1 for i in real]
            self.rows = np.concatenate([self.rows, rows])

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language, the mean negative log-probability of a character; and the characters (0: no letter)."""
        sums = np.zeros((len(texts), self.rows.shape[1]))
        for a, b in chunks(texts):
            kept = self.words.shrink()
            if kept is not None:
                self.rows = self.rows[kept]
            ids = [self.words.numbers(WORD.findall(t.lower())) if t else np.zeros(0, np.int64) for t in texts[a:b]]
            self._learn()
            sizes = np.array([len(x) for x in ids])
            full = np.flatnonzero(sizes)
            if len(full):
                flat, starts = np.concatenate([ids[i] for i in full]), np.cumsum(sizes[full]) - sizes[full]
                self.words.used(flat)
                for j in range(sums.shape[1]):
                    sums[a + full, j] = np.add.reduceat(self.rows[flat, j], starts)
        n = sums[:, -1]
        return -sums[:, :-1] / np.maximum(n, 1)[:, None], n

    def of_bags(self, bags: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """entropies() of texts given as their words and counts."""
        sums = np.zeros((len(bags), self.rows.shape[1]))
        for i, (words, counts, *_) in enumerate(bags):
            ids = self.words.numbers(words)
            self._learn()
            sums[i] = np.asarray(counts, np.float64) @ self.rows[ids] if len(ids) else 0
        n = sums[:, -1]
        return -sums[:, :-1] / np.maximum(n, 1)[:, None], n

    def decide(self, texts: list[str | None]) -> list:
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        odds = np.exp(-(h - low[:, None]) * (self.model.kappa * np.minimum(n, LONG))[:, None])
        langs = self.model.langs
        usual = np.array([self.model.usual[x] for x in langs])
        odd = (low - usual[best, 0]) * np.sqrt(np.minimum(n, LONG)) > usual[best, 1]
        none = n == 0
        return [[UND if e else langs[i] for i, e in zip(best, none, strict=True)], np.where(none, 0.0, 1 / odds.sum(1)), odd | none]


def _calibrate(model: Model, bags: list[tuple[list[str], list[int], str]]) -> None:
    """Usual entropy and largest accepted deviation of each language, and the sharpness of scores, from (words, counts, language) of texts."""
    h, n = Scorer(model).of_bags(bags)
    truth = np.array([model.langs.index(x[2]) for x in bags], np.int64)
    far = []
    for j, lang in enumerate(model.langs):
        own = (truth == j) & (n > 0)
        usual = float(np.median(h[own, j])) if own.any() else float(np.median(h.min(1))) if len(h) else 10.0
        far.append((lang, usual, float(((h[own, j] - usual) * np.sqrt(np.minimum(n[own], LONG))).max()) if own.any() else 0.0))
    widest = max([x for *_, x in far] + [1.0])
    model.usual = {lang: (usual, SLACK * widest) for lang, usual, _ in far}
    costs = {}
    for kappa in (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
        z = -h * (kappa * np.minimum(n, LONG))[:, None]
        z = z - z.max(1, keepdims=True) if len(z) else z
        costs[kappa] = float(np.sum(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth])) if len(z) else kappa
    model.kappa = min(costs, key=costs.get)


def _split(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows (text or its hash, language) that teach and that calibrate, about one in CALIBRATE of each language; equal texts stay on one side."""
    langs: dict[str, list[str]] = {}
    for text, lang in sorted(rows):
        langs.setdefault(text, []).append(lang)
    taught, checked, teach, check = Counter(), Counter(), [], []
    for text, own in langs.items():
        aside = all(taught[x] >= (CALIBRATE - 1) * (checked[x] + 1) for x in own)
        (checked if aside else taught).update(own)
        (check if aside else teach).extend((text, x) for x in own)
    return teach, check


BAGS = T.StructType([T.StructField("h", T.LongType()), T.StructField("l", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (h, l, t) as (h, l, words, counts), the first of each (h, l) in this task."""
    seen: set = set()
    for batch in batches:
        for h, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if (h, lang) not in seen:
                seen.add((h, lang))
                bag = Counter(WORD.findall(text.lower()))
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([lang]), pa.array([list(bag)], pa.list_(pa.string())), pa.array([list(bag.values())], pa.list_(pa.int64()))], BAGS.fieldNames())


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = TRAIN_DOCS) -> Model | None:
    """A model of the languages in labelled, from at most sample of its distinct texts with letters, shared evenly by language; None if there are none.

    Every language has CALIBRATE texts, if there are so many. Those of least hash are taken, so the sample
    depends neither on how rows are stored nor on how many copies a text has.
    """
    usable = labelled.select(F.xxhash64(F.col(text_col), F.lit(3)).alias("h"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).filter("l IS NOT NULL").filter(F.col("t").rlike(r"\p{L}"))
    hashes = stored(usable.select("l", "h").distinct(), "texts")
    langs = hashes.select("l").distinct().count()
    if not langs:
        return None
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = hashes.withColumn("place", place).filter(F.col("place") <= max(CALIBRATE, sample // langs)).select("h", "l")
    # words are counted where the texts are; the driver gets counts of a sample of bounded rows
    found = usable.join(F.broadcast(chosen), ["h", "l"], "left_semi").select("h", "l", "t").mapInArrow(_bags, BAGS)  # bounded by the sample
    bags = {(r["h"], r["l"]): (r["words"], r["counts"], r["l"]) for r in found.dropDuplicates(["h", "l"]).collect()}
    teach, check = _split(list(bags))
    counts: dict[str, Counter] = {lang: Counter() for _, lang in teach}
    for key in teach:
        words, times, lang = bags[key]
        counts[lang].update({w: n for w, n in zip(words, times, strict=True) if any(map(str.isalpha, w))})
    counts = {lang: c for lang, c in counts.items() if c}
    if not counts:
        return None
    model = Model(counts)
    _calibrate(model, [bags[x] for x in check if x[1] in counts])
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, drop_rejected: bool = False) -> DataFrame:
    """docs with lang_pred, score and rejected; or, with drop_rejected, without the rejected rows and that column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def start():
        if shared.value is None:
            return lambda texts: [[UND] * len(texts), [0.0] * len(texts), [True] * len(texts)]
        return Scorer(shared.value).decide

    return with_columns(docs, text_col, FIELDS, start, keep, "rejected" if drop_rejected else None)
