"""Cases in which an operator once did a part of its job only."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import langid, mainpath, minhash, pieces, pitmanyor, q_langid, registry, secrets, toxicity, vectors
from tests.llm.test_against_brute_force import brute_classes as brute_classes_of


def texts_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_rows_of_one_id_lose_their_own_secrets(spark):
    one, two, clean = "password=hunter22 first", "the second has token=abcdef99 in it", "nothing to hide in this text"
    rows = [(i, t) for i in (1, None) for t in (one, two, clean, None)] + [(1, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = ["[assign] first", "the second has [assign] in it", clean, ""]
    assert texts_of(secrets.redact(docs)) == sorted([(i is None, i or 0, t) for i in (1, None) for t in want] + [(False, 1, want[0])])


def test_one_contaminated_row_takes_no_other_of_its_id(spark, folder):
    item = next(r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len(r["text"].split()) >= 12)
    rows = [(i, t) for i in (1, None) for t in (f"before {item} after", "clean words only", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    kept = corpus_pipeline.decontaminated(spark, docs, folder)
    assert texts_of(kept) == sorted((i is None, i or 0, t) for i in (1, None) for t in ("clean words only", ""))


def test_known_words_beyond_sixteen_bits(spark, monkeypatch):
    monkeypatch.setattr(pitmanyor, "SAMPLE", 0)  # no word but the end is in the head
    docs = spark.createDataFrame([(1, "rare " * 70_000), (2, "rare " * 70_000 + "unknown")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in pitmanyor.score(docs, F.col("doc_id") == 2).collect()}
    assert rows == {1: (70_001, 70_001), 2: (70_002, 70_001)}


def test_copies_do_not_crowd_a_language_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "_calibrate", lambda model, bags: seen.extend((tuple(words), lang) for words, _, lang in bags))
    english, french = [f"the number {'abcdefghij'[i % 10] * (i // 10 + 1)} is here" for i in range(200)], [f"le nombre {x} est la" for x in ("un", "deux", "trois", "quatre", "cinq")]
    rows = [(t, "en") for t in english] + [(t, "fr") for t in french] + [(french[0], "fr")] * 2000 + [(english[0], "en")] * 400 + [("only one text", "nl")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample=24)
    assert model.langs == ["en", "fr", "nl"]
    assert [len([x for x in seen if x[1] == lang]) for lang in ("en", "fr", "nl")] == [2, 1, 0] and len(set(seen)) == len(seen)


def test_equal_texts_stay_on_one_side():
    rows = [(f"text {i}", "en") for i in range(40)] + [(f"text {i}", "de") for i in range(0, 40, 3)]
    teach, check = langid._split(rows)
    assert sorted(teach + check) == sorted(rows) and check and not {t for t, _ in teach} & {t for t, _ in check}


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    """Two near texts in 5,000 repeated rows each, and 2,000 drifting copies: comparisons grow with the texts, not with pairs of rows."""
    seen = []
    verified = minhash.verified

    def counted(pairs, texts, *rest):
        seen.append((pairs.count(), texts.groupBy("key").count().filter("count > 1").count()))
        return verified(pairs, texts, *rest)

    monkeypatch.setattr(minhash, "verified", counted)
    base = [f"word{i}" for i in range(80)]
    drift = [" ".join([*base[:60], *(f"d{i}_{j}" for j in range(3))]) for i in range(2000)]
    one, two = " ".join(base), " ".join(base) + " more"
    rows = [(1, one)] * 5000 + [(None, two)] * 5000 + list(enumerate(drift, 10))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).distinct().collect()}
    assert set(got.values()) == {1, 10} and got[1] == got[None] == 1
    assert all(pairs <= 36 * 2002 and not repeated for pairs, repeated in seen)


def test_an_id_of_two_texts_keeps_both(spark):
    """A near copy goes even if its id also names another text; texts of white space alone are all kept."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, "something else"), (3, "\n\t"), (4, "\u00a0\n"), (5, "\n\t"), (None, base), (None, "lonely"), (None, "lonely"), (None, None), (None, None)]
    kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, base), (2, "something else"), (3, "\n\t"), (4, "\u00a0\n"), (5, "\n\t"), (0, "lonely"), (0, "")])


def test_one_label_and_repeated_ids(spark):
    """One label tells nothing apart; of rows that share an id one text is learned from."""
    net = toxicity.fit(["a bad day", "another"], [1, 1])
    assert set(toxicity.Scorer(net).scores(["a bad day", "x", None])) == {toxicity.THRESHOLD / 2}
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, y: seen.extend(texts)
    try:
        docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (None, "none")], "doc_id long, text string")
        toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int"))
    finally:
        toxicity.fit = fit
    assert len(seen) == 2 and "other" in seen


def test_many_copies_do_not_empty_the_language_model(spark):
    rows = [(f"the text number {'abcdefghijklmnopqrst'[i]} of this", "en") for i in range(20) for _ in range(2000)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model is not None and model.langs == ["en"]


def test_vectors_of_other_labels_and_lengths_never_meet(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [1.0, 0.0, 0.0], f"label{i % 2}") for i in range(60)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    groups = {i: [j for j in range(60) if j % 2 == i % 2 and (j % 3 == 0) == (i % 3 == 0)] for i in range(60)}
    assert found == {i: (len(g) - 1, g[0]) for i, g in groups.items()}


def test_decoding_nulls_and_empty_lists(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, pieces.load().encode("some text"))], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(rows, pieces.load()).collect()} == {1: None, 2: "", 3: "some text"}


def test_pages_that_repeat_and_clash(spark):
    rows = [(1, "<p>One text, here.</p>", "old", 3)] * 3 + [(None, None, "old", 4)]
    found = mainpath.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int"))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found.collect()) == [(0, "", 0)] + [(1, "One text, here.", 15)] * 3
    assert mainpath.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int").limit(0)).count() == 0


def test_pipeline_equals_a_plain_run(spark, folder):
    """All stages over the whole table: the model on one machine, all pairs, all windows, SQL's spans, the library's pieces."""
    sentencepiece = pytest.importorskip("sentencepiece")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    langs, _, rejected = langid.Scorer(q_langid.learn(table)).decide(list(docs.values()))
    lang = dict(zip(docs, langs, strict=True))
    docs = {i: t for (i, t), gone in zip(docs.items(), rejected, strict=True) if not gone}
    classes = brute_classes_of(docs)
    docs = {i: t for i, t in docs.items() if classes[i] == i}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    docs = {i: t for i, t in docs.items() if not hit(words(t))}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(docs), "text": list(docs.values())}))
    found = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, spans FROM ({registry.ORACLES['op6_secrets']})").fetchall()}
    for i, spans in found.items():
        out, at = [], 0
        for kind, s, e in (x.split(":") for x in spans.split(",") if x):
            if int(s) >= at:
                out += [docs[i][at : int(s)], f"[{kind}]"]
            at = max(at, int(e))
        docs[i] = "".join(out) + docs[i][at:]
    ids = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(list(docs.values()))
    got = {r["doc_id"]: (r["lang"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: (lang[i], x) for i, x in zip(docs, ids, strict=True)}
