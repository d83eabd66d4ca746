"""Personal data: generators, boosted trees over format and context, thresholds. DataFrame functions only.

Base spans (email, ip, card, phone) are found and validated exactly. High-recall generators propose
further, overlapping spans: disguised addresses, groups of digits, runs of digits, account numbers.
Features of each proposal (kind, number of digits and separators, neighbours, key words among the CONTEXT = 32 code
points just before) are small integers, so training needs only the counts of each feature row: a table
whose size depends on the features and not on the corpus. Labels come from evidence that no feature shows:
a proposal is taken for genuine if its digits or letters pass a check of their own (Luhn, the check digits
of an account number, a numbering plan, a known top-level domain) or if it is a base span. Trees learn, on the
counts of one part of the documents, which formats and contexts go with such proposals; the threshold is set on
the other part, for a precision of PRECISION against those labels, and the trees are compiled into a SQL
expression that scores every proposal, whether it passes its check or not. Selected proposals that overlap no
base span join the spans.

Nulls: a null text is an empty text; a null id is kept. Equal rows give equal results; rows of one id with
different texts each get their own. Long texts are read whole. Columns beyond those named are ignored; an empty table
gives an empty result. Without proposals, or without genuine ones, nothing is added to the base.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import extract, joined_spans, match_spans, stored

KINDS = ("email", "ip", "card", "phone", "disguised", "digits", "run", "account")
BASE = KINDS[:4]
CONTEXT = 32
CELL = 256

# Possessive quantifiers and the look-behind keep time linear; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DISGUISED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]++)++"
DIGITS = r"(?<![0-9])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9])"
RUN = r"[0-9]{9,}"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}(?![A-Za-z0-9])"

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Key words just before a proposal, by code; the first that occurs counts.
WORDS = (r"\b(?:tel|phone|call|fax|mobile|cell)\b", r"\b(?:card|visa|credit|amex|mastercard)\b", r"\b(?:ssn|social security)\b", r"\b(?:e-?mail|contact|write)\b", r"\b(?:iban|account|acct)\b")
#: Numbering plans, on digits alone: North American telephone numbers, US social security numbers.
PLANS = (r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$", r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
#: Last parts of host names that a disguised address is checked against; so is any of two letters.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "dev", "app", "io")

FEATURES = ("k", "digits", "seps", "word", "before", "after")
ROUNDS, RATE, MIN_WEIGHT = 30, 0.3, 1.0
#: Precision that the threshold must reach on the part kept out of training.
PRECISION = 0.9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _base(name: str, spans: Column) -> Column:
    k = KINDS.index(name)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), F.lit(name).alias("kind"), x["e"].alias("e")))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike("^[A-Za-z]$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^\s$"), 0).otherwise(3)


def _account_valid(m: Column) -> Column:
    """Check digits of an international account number: the first four characters moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    turned = F.concat(F.substring(m, 5, 1000), F.substring(m, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, "(?!^)"), F.lit(0), lambda acc, c: (F.when(c.rlike("[0-9]"), acc * 10).otherwise(acc * 100) + value(c)) % 97) == 1


def _genuine(name: str, m: Column) -> Column:
    """Whether a proposal passes the check of its kind."""
    if name == "account":
        return _account_valid(m)
    if name == "disguised":
        last = F.lower(F.regexp_extract(m, "([A-Za-z0-9]+)$", 1))
        return last.isin(*DOMAINS) | last.rlike("^[a-z]{2}$")
    digits = _digits(m)
    n = F.length(digits)
    card = (n >= 12) & (n <= 19) & F.call_function("luhn_check", digits)
    return card | digits.rlike(PLANS[0]) | digits.rlike(PLANS[1])


def _proposal(name: str, spans: Column) -> Column:
    k = KINDS.index(name)

    def features(x: Column) -> Column:
        n = F.length(_digits(x["m"]))
        word = F.lit(0)
        for code in range(len(WORDS), 0, -1):
            word = F.when(F.lower(x["b"]).rlike(WORDS[code - 1]), code).otherwise(word)
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"),
            F.least(F.floor(n / 2), F.lit(10)).cast("int").alias("digits"),
            F.least(F.length(x["m"]) - n, F.lit(7)).cast("int").alias("seps"),
            word.alias("word"),
            _side(F.right(x["b"], F.lit(1))).alias("before"), _side(F.substring(x["a"], 1, 1)).alias("after"),
            _genuine(name, x["m"]).alias("genuine"),
        )

    return F.transform(spans, features)


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, _h, base (validated spans) and more (proposals with features)."""
    t = F.col("t")
    numbers = t.rlike("[0-9]")
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "*",
        extract(t.contains("@"), t, EMAIL).alias("email"),
        extract(numbers & t.contains("."), t, IP).alias("ip"),
        extract(numbers, t, CARD).alias("card"),
        extract(t.contains("+"), t, PHONE).alias("phone"),
        extract(t.rlike(r"[\[({]at[\])}]"), t, DISGUISED).alias("disguised"),
        extract(numbers, t, DIGITS).alias("digits"),
        extract(numbers, t, RUN).alias("run"),
        extract(numbers, t, ACCOUNT).alias("account"),
    )
    spans = lambda name, pattern, context=0: match_spans(t, pattern, F.col(name), context)
    n = lambda x: F.length(_digits(x["m"]))
    base = F.concat(
        _base("email", spans("email", EMAIL)),
        _base("ip", F.filter(spans("ip", IP), lambda x: x["m"].rlike(IP_VALID))),
        _base("card", F.filter(spans("card", CARD), lambda x: (n(x) >= 12) & (n(x) <= 19) & F.call_function("luhn_check", _digits(x["m"])))),
        _base("phone", F.filter(spans("phone", PHONE), lambda x: (n(x) >= 9) & (n(x) <= 15))),
    )
    more = F.concat(*(_proposal(name, spans(name, pattern, CONTEXT)) for name, pattern in (("disguised", DISGUISED), ("digits", DIGITS), ("run", RUN), ("account", ACCOUNT))))
    return found.select("_id", "_h", base.alias("base"), more.alias("more"))


def _rows(found: DataFrame) -> DataFrame:
    """Proposals as rows, with over: whether a base span overlaps, and same: whether one has the same place."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    rows = found.filter(F.size("more") > 0).select("_id", "_h", F.explode("more").alias("x")).select("_id", "_h", "x.*").distinct()
    near = rows.withColumn("cell", cells(F.col("s"), F.col("e")))
    base = found.filter((F.size("more") > 0) & (F.size("base") > 0)).select(F.col("_id").alias("i2"), F.col("_h").alias("h2"), F.explode("base").alias("y")).distinct()
    base = base.select("i2", "h2", F.col("y.s").alias("s2"), F.col("y.e").alias("e2")).withColumn("cell2", cells(F.col("s2"), F.col("e2")))
    met = near.join(base, F.col("_id").eqNullSafe(F.col("i2")) & (F.col("_h") == F.col("h2")) & (F.col("cell") == F.col("cell2")) & (F.col("s2") < F.col("e")) & (F.col("e2") > F.col("s")), "left")
    same = (F.col("s2") == F.col("s")) & (F.col("e2") == F.col("e"))
    return met.groupBy("_id", "_h", "s", "e", *FEATURES, "genuine").agg(F.max(F.col("i2").isNotNull() | F.col("h2").isNotNull()).alias("over"), F.coalesce(F.max(same), F.lit(False)).alias("same"))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int) -> dict:
    """A regression tree on counted rows: the split of largest gain, depth times."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best: tuple | None = None
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows & (x[:, f] <= cut)
                gl, hl = grad[left].sum(), hess[left].sum()
                if min(hl, h - hl) > 1e-6:
                    gain = gl * gl / (hl + MIN_WEIGHT) + (g - gl) ** 2 / (h - hl + MIN_WEIGHT) - g * g / (h + MIN_WEIGHT)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, f, int(cut), left)
    if best is None:
        return {"value": float(RATE * g / (h + MIN_WEIGHT))}
    _, f, cut, left = best
    return {"f": f, "cut": cut, "low": _grow(x, grad, hess, left, depth - 1), "high": _grow(x, grad, hess, rows & ~left, depth - 1)}


def _apply(tree: dict, x: np.ndarray) -> np.ndarray:
    if "value" in tree:
        return np.full(len(x), tree["value"])
    return np.where(x[:, tree["f"]] <= tree["cut"], _apply(tree["low"], x), _apply(tree["high"], x))


def _sql(tree: dict) -> str:
    if "value" in tree:
        return f"{tree['value']!r}D"
    return f"IF({FEATURES[tree['f']]} <= {tree['cut']}, {_sql(tree['low'])}, {_sql(tree['high'])})"


def train(rows: DataFrame) -> tuple[str, float]:
    """The log-odds as a SQL expression over FEATURES, and the least log-odds to select."""
    part = F.pmod(F.col("_h"), F.lit(4)) == 0
    counted = rows.groupBy(*FEATURES, (F.col("same") | F.col("genuine")).alias("label"), part.alias("kept")).agg(F.count("*").alias("n")).collect()
    fit, test = [r for r in counted if not r["kept"]], [r for r in counted if r["kept"]]
    positive = sum(r["n"] for r in fit if r["label"])
    total = sum(r["n"] for r in fit)
    if not positive or not test:
        return "0.0D", math.inf
    x, y, n = (np.array([[r[f] for f in FEATURES] for r in fit]), np.array([float(r["label"]) for r in fit]), np.array([float(r["n"]) for r in fit]))
    bias = math.log((positive + 1) / (total - positive + 1))
    score, trees = np.full(len(y), bias), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, n * (y - p), n * p * (1 - p), np.ones(len(y), bool), 3))
        score += _apply(trees[-1], x)
    tx, ty, tn = (np.array([[r[f] for f in FEATURES] for r in test]), np.array([float(r["label"]) for r in test]), np.array([float(r["n"]) for r in test]))
    held = bias + sum(_apply(t, tx) for t in trees)
    least = math.inf
    for cut in np.unique(held)[::-1]:
        chosen = held >= cut
        if (tn * ty)[chosen].sum() < PRECISION * tn[chosen].sum():
            break
        least = float(cut)
    return f"({bias!r}D + " + " + ".join(_sql(t) for t in trees) + ")", max(least, 0.0) - 1e-9


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of struct<s,k,kind,e> sorted by start, then kind."""
    found = stored(proposals(docs, id_col, text_col), "pii")
    rows = stored(_rows(found), "pii-rows")
    model, least = train(rows)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    none = F.expr("CAST(array() AS array<struct<s:int,k:int,kind:string,e:int>>)")
    if math.isinf(least):
        return found.select(F.col("_id").alias("doc_id"), F.array_sort("base").alias("base"), F.array_sort("base").alias("spans"))
    chosen = rows.filter(~F.col("over")).filter(F.expr(model) >= least)
    best = chosen.groupBy("_id", "_h", "s", "e").agg(F.min("k").alias("k"))
    more = best.groupBy(F.col("_id").alias("i3"), F.col("_h").alias("h3")).agg(F.collect_list(F.struct("s", "k", name.alias("kind"), "e")).alias("chosen"))
    both = found.join(more, F.col("_id").eqNullSafe(F.col("i3")) & (F.col("_h") == F.col("h3")), "left")
    return both.select(F.col("_id").alias("doc_id"), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("chosen", none))).alias("spans"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    return F.sha2(joined_spans(spans), 256)
