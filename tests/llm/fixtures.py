"""Documents that no operator may stumble over."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
RUN = "a" * 200_000
DIGITS = "1 " * 60_000
BASE = " ".join(f"word{i}" for i in range(80))
NEAR = BASE + " extra"

#: doc_id, text, lang
ROWS = [
    (1, BASE, "en"), (2, NEAR, "en"), (3, None, "en"), (4, "", None), (5, "   \n\t ", "en"), (6, LONG, "en"), (7, RUN, "de"), (8, "short", "fr"), (9, "short", "fr"),
    (1, BASE, "en"), (None, BASE, "en"), (None, None, None), (10, "12 34", "en"), (11, "\u0000▁ é 日本 😀", "es"), (12, DIGITS, None), (13, "@ + AKIA :// = : [at]", "en"),
    (14, "password=\"hunter22\" mail a@b.co ip 1.2.3.4 card 4111 1111 1111 1111 tel +49 (30) 1234567", "en"), (15, "x" * 15 + "@", "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean, ids array<int>, key long, k1 long, t string, _id long, spans string, bad int"


def odd(spark):
    """The rows, with columns named like the operators' own."""
    rows = [(i, t, lang, "s", None if t is None else len(t), 0.5, True, [1], 7, 8, "t", 9, "spans", 1) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def plain(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
