"""Query over `documents` and `benchmark`: decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import table
from screenlab.llm.decontaminate import find_matches, words_hit

NAME = "op10_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform("matches", lambda m: m["item"].cast("string")))
    items = F.array_sort(F.array_compact(items))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", words_hit(F.col("matches")).alias("n_hit"), items.alias("_i")
    ).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_i").cast("long").alias("n_items"),
        F.sha2(F.array_join("_i", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
  FROM benchmark
), k AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT r, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.x = dw.x
), words AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.x, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
