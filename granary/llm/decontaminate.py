"""Benchmark decontamination over a positional inverted index. DataFrame functions only.

The corpus is indexed by term: postings(term, document, position) are written for the terms that
some benchmark window needs, namely the two rarest of each window by corpus count. For every
alignment (document, item, document position minus item position) the offset-adjusted lists are
intersected, rarest terms first; alignments that hold both rare terms of some window are compared
with the item's words, which gives the exact phrase matches. Only texts of documents with such alignments are moved. proximity() answers the looser question
from the same postings.

Nulls: a null text has no words; a null id is an id like any other, but a null item_id is not counted
or listed. Equal rows give equal results, repeated items count once; rows of one id are searched each by its own text, whole. Columns beyond those named are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import BROADCAST_BYTES, forget, maybe_broadcast, small, stored, word_array

#: Words in a window; an item of fewer, but not none, is one window.
WINDOW = 10
#: Rare terms of each window whose lists are intersected.
RAREST = 2


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h")]


def _positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = docs.select(*_key(id_col, text_col), word_array(F.col(text_col)).alias("_w"))
    return words.select("_id", "_h", F.posexplode("_w").alias("pos", "term"))


def item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct items that have words: item (as text), words, n, and a key made of both."""
    return (
        items.select(F.col(item_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("words"))
        .filter(F.size("words") > 0)
        .distinct()
        .select(F.xxhash64("item", "words").alias("ikey"), "item", "words", F.size("words").alias("n"))
    )


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame, broadcast: bool) -> DataFrame:
    """Occurrences in the whole corpus of each given term that occurs: term, freq."""
    words = docs.select(F.explode(word_array(F.col(text_col))).alias("term"))
    return words.join(maybe_broadcast(terms, broadcast), "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))


def rare_positions(items: DataFrame, counts: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """ikey, ipos, term: for every window that can occur, the places of its rarest terms."""
    places = items.select("ikey", "n", F.posexplode("words").alias("ipos", "term"))
    per_item = (
        places.join(counts, "term", "left")
        .groupBy("ikey", "n")
        .agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("freq", F.lit(0)).alias("freq"), "term"))).alias("at"))
    )
    picks = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0))),
            lambda j: F.transform(
                F.slice(F.array_sort(F.transform(F.slice("at", j + 1, window), lambda x: F.struct(x["freq"].alias("freq"), x["term"].alias("term"), x["ipos"].alias("ipos")))), 1, rarest),
                lambda x: F.struct(x["ipos"].alias("ipos"), x["term"].alias("term"), x["freq"].alias("freq")),
            ),
        )
    )
    chosen = per_item.select("ikey", F.explode(F.array_distinct(picks)).alias("x")).select("ikey", "x.ipos", "x.term", "x.freq")
    return chosen.filter("freq > 0").drop("freq")


def postings(docs: DataFrame, anchors: DataFrame, id_col: str, text_col: str, broadcast: bool) -> DataFrame:
    """The stored index of the rare terms: term, _id, _h, pos."""
    terms = anchors.select("term").distinct()
    return stored(_positions(docs, id_col, text_col).join(maybe_broadcast(terms, broadcast), "term", "left_semi"), "postings")


def alignments(index: DataFrame, anchors: DataFrame, items: DataFrame, broadcast: bool, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """_id, _h, ikey, delta where enough offset-adjusted lists meet."""
    lists = anchors.join(items.select("ikey", "n"), "ikey")
    met = index.join(maybe_broadcast(lists, broadcast), "term").select("_id", "_h", "ikey", "n", (F.col("pos") - F.col("ipos")).alias("delta"))
    return met.groupBy("_id", "_h", "ikey", "n", "delta").agg(F.count("*").alias("met")).filter(F.col("met") >= F.least(F.lit(rarest), F.col("n"), F.lit(window))).drop("met", "n")


def _starts(words: Column, x: Column, delta: Column, window: int) -> Column:
    """Document positions at which a window of the item x occurs in words under the alignment delta."""
    size = F.least(x["n"], F.lit(window))
    low, high = F.greatest(F.lit(0), -delta), F.least(x["n"], F.size(words) - delta) - size
    places = F.filter(
        F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("CAST(array() AS array<int>)")),
        lambda j: F.slice(words, delta + j + 1, size) == F.slice(x["words"], j + 1, size),
    )
    return F.transform(places, lambda j: delta + j)


def _hits(docs: DataFrame, by_doc: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """_i, _g, n_hit, items of the documents that have candidates. Only their texts are moved: their names are broadcast if they are few."""
    few = by_doc.count() * 32 <= BROADCAST_BYTES
    names = by_doc.select("_i", "_g")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))
    texts = docs.select(*_key(id_col, text_col), F.col(text_col).alias("t")).join(maybe_broadcast(names, few), same, "left_semi").groupBy("_id", "_h").agg(F.first("t").alias("t"))
    both = texts.join(by_doc, same).select("_i", "_g", "cands", word_array(F.col("t")).alias("w"))
    at = lambda x: F.flatten(F.transform(x["deltas"], lambda d: _starts(F.col("w"), x, d, window)))
    hits = F.filter(F.transform("cands", lambda x: F.struct(x["item"].alias("item"), F.least(x["n"], F.lit(window)).alias("size"), at(x).alias("at"))), lambda x: F.size(x["at"]) > 0)
    found = both.select("_i", "_g", hits.alias("hits"))
    inside = F.flatten(F.transform("hits", lambda x: F.flatten(F.transform(x["at"], lambda p: F.sequence(p, p + x["size"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda x: x["item"]), lambda i: i.isNotNull())))
    return found.select("_i", "_g", F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), ids.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items (sorted texts of ids), contaminated."""
    tiny = small(benchmark, item_text)
    items = stored(item_words(benchmark, item_col, item_text), "items")
    counts = term_counts(docs, text_col, items.select(F.explode("words").alias("term")).distinct(), tiny)
    anchors = stored(rare_positions(items, counts, window), "anchors")
    index = postings(docs, anchors, id_col, text_col, tiny)
    # an item's words are listed once for a document, whatever the number of its alignments
    found = alignments(index, anchors, items, tiny, window).groupBy("_id", "_h", "ikey").agg(F.collect_list("delta").alias("deltas")).join(maybe_broadcast(items, tiny), "ikey")
    by_doc = stored(found.groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(F.collect_list(F.struct("item", "words", "n", "deltas")).alias("cands")), "candidates")
    forget(index, anchors)
    hits = stored(_hits(docs, by_doc, id_col, text_col, window), "hits")
    forget(items, by_doc)

    none = F.expr("CAST(array() AS array<string>)")
    whole = docs.select(*_key(id_col, text_col), F.size(word_array(F.col(text_col))).cast("long").alias("n_words"))
    both = whole.join(hits, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    out = both.select(F.col("_id").alias("doc_id"), F.col("_h").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, item, n_met: items of which at least two rare terms of a window lie within slack of their places.

    Offsets are compared in cells of slack words and their right neighbours, so that terms moved by
    up to slack words against each other still meet in a cell.
    """
    tiny = small(benchmark, item_text)
    items = stored(item_words(benchmark, item_col, item_text), "items")
    counts = term_counts(docs, text_col, items.select(F.explode("words").alias("term")).distinct(), tiny)
    anchors = stored(rare_positions(items, counts, window), "anchors")
    index = postings(docs, anchors, id_col, text_col, tiny)
    lists = anchors.join(items.select("ikey", "item"), "ikey")
    cell = F.floor((F.col("pos") - F.col("ipos")) / max(slack, 1))
    met = index.join(maybe_broadcast(lists, tiny), "term").select("_id", "_h", "item", "ikey", "ipos", F.explode(F.array(cell, cell + 1)).alias("cell"))
    near = met.groupBy("_id", "_h", "item", "ikey", "cell").agg(F.size(F.collect_set("ipos")).alias("n")).filter("n >= 2")
    return near.groupBy(F.col("_id").alias("doc_id"), "item").agg(F.max("n").cast("long").alias("n_met"))
