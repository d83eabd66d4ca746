"""What several operators of this package share: storage for cut lineage, splits, words and spans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators between words: every ASCII character that is not a digit or (after folding) a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables up to this many bytes of text are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where unset and all runs in one process (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.granary_path = path
    return out


def forget(*used: DataFrame) -> None:
    """Delete what stored() wrote for each, when nothing reads it any more."""
    for df in used:
        path = getattr(df, "granary_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """A-Z folded, everything else kept. lower() is the quick way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_array(text: Column) -> Column:
    """Words of a text (null: none), A-Z folded, split at SEPARATORS."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def small(df: DataFrame, text: str) -> bool:
    """Whether the table's text fits BROADCAST_BYTES: the check before any broadcast."""
    size = df.agg(F.sum(F.octet_length(F.col(text)) + 64)).first()[0] or 0
    return size <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, yes: bool) -> DataFrame:
    return F.broadcast(df) if yes else df


BLOCK = 256


def match_spans(text: Column, pattern: str, matches: Column, context: int = 0) -> Column:
    """array<struct<s,e,m,b,a>> of the leftmost non-overlapping matches, in code points, end exclusive.

    matches is regexp_extract_all(text, pattern, 0), as a column of its own. Starts are running
    sums of the lengths of matches and of the pieces between them, summed in blocks so that a text
    with very many matches costs time in proportion. b and a are the last context code points of the
    piece before and the first of the piece after (empty where context is 0).
    """
    kind = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
    empty = F.expr(f"CAST(array() AS {kind})")
    pieces = F.split(text, pattern, -1)
    n = F.size(matches)
    beside = lambda p, q: F.struct(F.length(p).alias("p"), (F.right(p, F.lit(context)) if context else F.lit("")).alias("b"), (F.substring(q, 1, context) if context else F.lit("")).alias("a"))
    pairs = F.zip_with(F.zip_with(F.slice(pieces, 1, n), F.slice(pieces, 2, n), beside), matches, lambda x, m: F.struct(x["p"].alias("p"), x["b"].alias("b"), x["a"].alias("a"), m.alias("m"), F.length(m).alias("l")))
    place = lambda at, x: F.struct((at + x["p"]).alias("s"), (at + x["p"] + x["l"]).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))
    step = lambda acc, x: F.struct((acc["at"] + x["p"] + x["l"]).alias("at"), F.concat(acc["spans"], F.array(place(acc["at"], x))).alias("spans"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, BLOCK), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step),
    )
    move = lambda by, x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))
    moved = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<{kind}>)").alias("all")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(F.transform(b["spans"], lambda x: move(acc["at"], x)))).alias("all")),
    )
    return F.when(F.size(matches) > 0, F.flatten(moved["all"])).otherwise(empty)


def extract(guard: Column | None, text: Column, pattern: str) -> Column:
    """regexp_extract_all, skipped where a cheap necessary condition fails."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if guard is None else F.when(guard, found).otherwise(F.expr("CAST(array() AS array<string>)"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, of array<struct<s,k,kind,e>> sorted by start, then kind's place."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
