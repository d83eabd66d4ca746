"""Query of the seventh operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.decontaminate import decontaminate
from granary.sources.tables import table


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT DISTINCT item_id::VARCHAR AS item,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[j : j + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS j FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, j, size, array_to_string(ws[j : j + size - 1], ' ') AS gram
  FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS j FROM w, sizes WHERE len(ws) >= size)),
hit AS (SELECT rid, j, dw.size, item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.size = bw.size),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(j, j + size)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT item)) AS ids FROM hit WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": SQL}
