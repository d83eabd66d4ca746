"""Query of the sixth operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import secrets as S
from granary.llm.common import joined_spans
from granary.sources.tables import table


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.scan(table(spark, sf_dir, "documents"))
    counts = [S.count_kind(found["base"], kind).alias(f"n_{kind}") for kind in S.BASE]
    return found.select("doc_id", *counts, S.digest(found["base"]).alias("base_sha256"), joined_spans(found["spans"]).alias("spans"))


def _spans(name: str, pattern: str, test: str = "true") -> str:
    """A list of {s, k, kind, e} for one kind, from column t."""
    p = "'" + pattern.replace("'", "''") + "'"
    k = ("assign", "access", "hex", "id", "key", "endpoint").index(name)
    return f"""list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{
        's': (list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda x: length(x))), 0))::INT,
        'm': regexp_extract_all(t, {p})[i]}}), lambda x: {test}), lambda x: {{'s': x.s, 'k': {k}, 'kind': '{name}', 'e': (x.s + length(x.m))::INT}})"""


# written out here once more, so that a slip in the operator's own patterns shows
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ENDPOINT = r"""(?:https?|ftp|ssh|s3|jdbc|postgres|postgresql|mysql|redis|mongodb|amqp)://[^\x00-\x20"'<>]+"""
_VALUE = "'" + ASSIGN.replace("'", "''") + "'"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, rid,
  list_concat({_spans("assign", ASSIGN, f"length(regexp_extract(x.m, {_VALUE}, 2)) >= 6")},
    list_concat({_spans("access", "AKIA[A-Z0-9]+", "length(x.m) >= 20")}, {_spans("hex", "[0-9a-f]+", "length(x.m) >= 24")})) AS base,
  list_concat({_spans("id", "[A-Za-z0-9+/_-]{16,}", "regexp_matches(x.m, '^[A-Z][A-Z0-9]{15,39}$') AND regexp_matches(x.m, '[0-9]')")},
    list_concat({_spans("key", "[A-Za-z0-9+/_-]{16,}", "length(x.m) >= 32 AND regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[a-z]') AND regexp_matches(x.m, '[A-Z]')")},
      {_spans("endpoint", ENDPOINT)})) AS weak FROM d),
a AS (SELECT rid, unnest(weak) AS x FROM p),
b AS (SELECT rid, unnest(list_concat(base, weak)) AS y FROM p),
j AS (SELECT a.rid, x, (y.e <= x.s OR y.s >= x.e) AS apart, y.k < 3 AS strong,
        CASE WHEN y.kind IN ('access', 'id') THEN 'I' WHEN y.kind = 'endpoint' THEN 'E' ELSE 'S' END AS r
      FROM a JOIN b ON a.rid = b.rid AND y.s <= x.e + 200 AND y.e >= x.s - 200),
g AS (SELECT rid, x, bool_or(apart AND r = 'I') AS i, bool_or(apart AND r = 'S') AS s, bool_or(apart AND r = 'E') AS e, bool_or(NOT apart AND strong) AS within
      FROM j GROUP BY rid, x),
l AS (SELECT rid, list(x) AS linked FROM g
      WHERE NOT within AND CASE x.kind WHEN 'id' THEN s WHEN 'key' THEN i OR e ELSE i AND s END GROUP BY rid)
SELECT doc_id, len(list_filter(base, lambda x: x.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(base, lambda x: x.kind = 'access'))::BIGINT AS n_access,
  len(list_filter(base, lambda x: x.kind = 'hex'))::BIGINT AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_sort(base), lambda x: x.kind || ':' || x.s || ':' || x.e), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(list_sort(list_concat(base, coalesce(linked, []))), lambda x: x.kind || ':' || x.s || ':' || x.e), ','), '') AS spans
FROM p LEFT JOIN l USING (rid)
"""

QUERIES = {"op6_secrets": op6_secrets}
ORACLES = {"op6_secrets": SQL}
