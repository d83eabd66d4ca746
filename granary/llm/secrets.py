"""Secret scanning with multipart credential linking. DataFrame functions only.

Strong spans (assign, access, hex) stand alone. Weak parts (identifier-like and key-like tokens,
endpoints) are reported only when complementary parts lie in their scope: the interval of a weak part,
widened by SCOPE code points, is joined with the intervals of the document's other parts, by cells
of position, so that no cell holds more parts than fit into it. An identifier needs a secret in scope,
a key an identifier or an endpoint, an endpoint an identifier and a secret. Parts that overlap are the
same text, not complements; a weak part that overlaps a strong span is not reported.

Nulls: a null text is an empty text and has no spans; a null id is kept. Equal rows give equal results.
Columns beyond those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import extract, joined_spans, match_spans, stored

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
BASE = KINDS[:3]
#: Code points between a weak part and its complement, at most.
SCOPE = 200
CELL = 256

_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
ENDPOINT = r"""(?:https?|ftp|ssh|s3|jdbc|postgres|postgresql|mysql|redis|mongodb|amqp)://[^\x00-\x20"'<>]+"""
WEAK_ID = r"^[A-Z][A-Z0-9]{15,39}$"


def _kind(name: str, spans: Column) -> Column:
    k = KINDS.index(name)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), F.lit(name).alias("kind"), x["e"].alias("e")))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, _h, base and weak, arrays of struct<s,k,kind,e>."""
    t = F.col("t")
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "*",
        extract(t.contains("=") | t.contains(":"), t, ASSIGN).alias("assign"),
        extract(t.contains("AKIA"), t, ACCESS).alias("access"),
        extract(None, t, HEX).alias("hex"),
        extract(t.rlike("[0-9]"), t, TOKEN).alias("token"),
        extract(t.contains("://"), t, ENDPOINT).alias("endpoint"),
    )
    tokens = match_spans(t, TOKEN, F.col("token"))
    mixed = lambda x: (F.length(x["m"]) >= 32) & x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]")
    is_id = lambda x: x["m"].rlike(WEAK_ID) & x["m"].rlike("[0-9]")
    assigned = F.filter(match_spans(t, ASSIGN, F.col("assign")), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    placed = found.select(
        "_id",
        "_h",
        _kind("assign", assigned).alias("assign"),
        _kind("access", match_spans(t, ACCESS, F.col("access"))).alias("access"),
        _kind("hex", match_spans(t, HEX, F.col("hex"))).alias("hex"),
        F.when(F.size("token") > 0, tokens).alias("token"),
        _kind("endpoint", match_spans(t, ENDPOINT, F.col("endpoint"))).alias("endpoint"),
    )
    none = F.expr("CAST(array() AS array<struct<s:int,k:int,kind:string,e:int>>)")
    weak = F.concat(F.coalesce(_kind("id", F.filter("token", is_id)), none), F.coalesce(_kind("key", F.filter("token", mixed)), none), F.col("endpoint"))
    return placed.select("_id", "_h", F.concat("assign", "access", "hex").alias("base"), weak.alias("weak"))


def linked(found: DataFrame) -> DataFrame:
    """_id, _h, linked: the weak parts whose complements lie in scope. Documents without any are absent."""
    rows = lambda column: found.filter(F.size("weak") > 0).select("_id", "_h", F.explode(column).alias("x")).select("_id", "_h", "x.*").distinct()
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    near = rows("weak").withColumn("cell", cells(F.col("s") - SCOPE, F.col("e") + SCOPE))
    role = F.when(F.col("kind").isin("access", "id"), "I").when(F.col("kind") == "endpoint", "E").otherwise("S")
    other = rows(F.concat("base", "weak")).select(F.col("_id").alias("i2"), F.col("_h").alias("h2"), F.col("s").alias("s2"), F.col("e").alias("e2"), role.alias("role"), (F.col("k") < len(BASE)).alias("strong"))
    other = other.withColumn("cell", cells(F.col("s2"), F.col("e2")))
    met = near.join(other, F.col("_id").eqNullSafe(F.col("i2")) & (F.col("_h") == F.col("h2")) & (near["cell"] == other["cell"]) & (F.col("s2") <= F.col("e") + SCOPE) & (F.col("e2") >= F.col("s") - SCOPE))
    apart = (F.col("e2") <= F.col("s")) | (F.col("s2") >= F.col("e"))
    has = lambda r: F.max(apart & (F.col("role") == r))
    seen = met.groupBy("_id", "_h", "s", "k", "kind", "e").agg(has("I").alias("i"), has("S").alias("sec"), has("E").alias("end"), F.max(~apart & F.col("strong")).alias("within"))
    told = F.when(F.col("kind") == "id", F.col("sec")).when(F.col("kind") == "key", F.col("i") | F.col("end")).otherwise(F.col("i") & F.col("sec"))
    return seen.filter(told & ~F.col("within")).groupBy("_id", "_h").agg(F.collect_list(F.struct("s", "k", "kind", "e")).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, base and spans, arrays of struct<s,k,kind,e> sorted by start, then kind."""
    found = stored(parts(docs, id_col, text_col), "secrets")
    more = linked(found).select(F.col("_id").alias("i3"), F.col("_h").alias("h3"), "linked")
    both = found.join(more, F.col("_id").eqNullSafe(F.col("i3")) & (F.col("_h") == F.col("h3")), "left")
    none = F.expr("CAST(array() AS array<struct<s:int,k:int,kind:string,e:int>>)")
    return both.select(F.col("_id").alias("doc_id"), F.col("_h").alias("text_hash"), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, in text_col every span replaced by [kind]; overlapping spans are merged.

    The text is rebuilt from the pieces between spans. A null text stays null. Rows are told apart by id and
    text, so rows that share an id, or have none, each lose their own spans.
    """
    spans = scan(docs, id_col, text_col).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__h"), F.col("spans").alias("__s"))
    # rows of equal id and text have equal spans
    grouped = spans.groupBy("__i", "__h").agg(F.first("__s").alias("__s"))
    both = docs.join(grouped, docs[id_col].eqNullSafe(F.col("__i")) & (F.xxhash64(docs[text_col]) == F.col("__h")), "left")
    return both.withColumn(text_col, F.when(F.col("__s").isNotNull(), redacted(F.col(text_col), F.col("__s"))).otherwise(F.col(text_col))).drop("__i", "__h", "__s")


def redacted(text: Column, spans: Column) -> Column:
    """text with the spans (sorted by start) replaced by [kind]; a span inside what is already replaced is skipped."""
    state = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(
            x["s"] >= acc["at"],
            F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    done = F.aggregate(spans, state, step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    return F.sha2(joined_spans(spans), 256)
