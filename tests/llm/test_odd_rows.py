"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import decontaminate, langid, mainpath, minhash, pieces, pii, pitmanyor, secrets, toxicity, vectors
from tests.llm.fixtures import DIGITS, ROWS, odd


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Short"), (2, None), (3, ""), (None, "short"), (1, "Short"), (4, " ".join(f"word{i}" for i in range(30, 60)))], "item_id long, text string")


def by_text(rows, column):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).add(r[column])
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_all_operators_give_a_row_for_each(spark, docs, bench, empty):
    table = docs.limit(0) if empty else docs
    n = 0 if empty else len(ROWS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    machine = pieces.load()
    assert minhash.classes(table).count() == n
    assert toxicity.score(table, toxicity.learn(table, labels)).count() == n
    assert langid.identify(table, langid.fit(table)).count() == n
    assert pitmanyor.score(table, F.col("doc_id") == 2).count() == n
    assert secrets.scan(table).count() == n
    assert secrets.redact(table).count() == n
    assert decontaminate.decontaminate(table, bench).count() == n
    assert decontaminate.decontaminate(table, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.proximity(table, bench, 3).count() >= 0
    encoded = pieces.encode(table, machine)
    assert encoded.filter("round_trip").count() == n
    assert pieces.decode(encoded, machine).count() == n
    assert pii.scan(table).count() == n


def test_minhash(docs):
    rows = {(r["doc_id"], r["class_id"]) for r in minhash.classes(docs).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 4), (5, 5), (8, 8), (9, 8), (None, None)} <= rows
    kept = [r["doc_id"] for r in minhash.deduplicate(docs).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 9 not in kept and {3, 4, 5, 6, 7, 8} <= set(kept)


def test_decontamination(docs, bench):
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert rows[8]["n_hit"] == 1 and rows[8]["items"] == ["1"] and rows[3]["n_words"] == 0
    assert rows[2]["n_hit"] == 30 and rows[2]["items"] == ["4"] and not rows[6]["contaminated"]


def test_spans(docs):
    found = {r["doc_id"]: [(x["kind"], x["s"], x["e"]) for x in r["base"]] for r in secrets.scan(docs).collect()}
    assert found[14] == [("assign", 0, 18)] and found[3] == [] and found[13] == []
    found = {r["doc_id"]: [x["kind"] for x in r["base"]] for r in pii.scan(docs).collect()}
    assert found[14] == ["email", "ip", "card", "phone"] and found[12] == [] and len(DIGITS) == 120_000
    text = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert text[14].startswith('[assign]" mail a@b.co') and text[3] is None


def test_language_and_toxicity_of_texts_without_words(docs):
    rows = by_text(langid.identify(docs, langid.fit(docs)).collect(), "lang_pred")
    assert rows[3] == rows[4] == rows[5] == rows[10] == {"und"} and rows[8] == {"fr"}
    net = toxicity.fit(["bad day", "good day"] * 4, [1, 0] * 4)
    scores = by_text(toxicity.score(docs, net).collect(), "score")
    assert all(0 <= x < toxicity.THRESHOLD for x in scores[3] | scores[4] | scores[5])


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>a&amp;b\n c<p>d"), (None, "u", "<div " * 20_000), (5, "u", "<p>" + "x " * 200_000)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in mainpath.extract(pages).collect()}
    assert rows[1]["text"] == rows[2]["text"] == "" and rows[3]["text"] == "a&b c\n\nd" and rows[5]["n_chars"] == 399_999


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1, 0), (2, [2.0, 0.0], 1, 0), (3, [1.0, 0.0], 2, 0), (4, None, 1, 0), (5, [0.0, 0.0], 1, 0), (6, [float("nan"), 1.0], 1, 0), (7, [None, 1.0], 1, 0),
        (8, [1.0, 0.0], None, 0), (1, [1.0, 0.0], 1, 0), (9, [], 1, 0), (10, [1.0, 0.0, 0.0], 1, 0), (11, [float("inf"), 1.0], 1, 0), (None, [0.0, 1.0], 1, 0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, ck long")
    found = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(table).collect()}
    assert found == {(1, 2, 1, True), (2, 2, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)), (None, 0, None, False)}
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, folder):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, now, folder)
        if name != "encoded":
            assert rows.columns == docs.columns
            ids = {r["doc_id"] for r in rows.select("doc_id").collect()}
            assert (6 in ids, 3 in ids) == (True, False)
            now = rows
    assert rows.filter("round_trip").count() == rows.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
