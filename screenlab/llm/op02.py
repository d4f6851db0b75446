"""Query over `documents`: substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import table
from screenlab.llm.repeats import RUN_WORDS, find_repeats

NAME = "op2_substring_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the spans cut out (start-end, in characters) and a digest of the text left."""
    found = find_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("chars_removed"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: Units by the same pattern; the words of a unit are split at white space.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), piece AS (
  SELECT doc_id, text, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\n.!?]+[.!?]*|[.!?]+|\n') AS p FROM d)
), placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start,
         trim(regexp_replace(lower(piece), '\s+', ' ', 'g'), ' ') AS unit
  FROM piece
), u AS (
  SELECT doc_id, text, start, start + length(piece) AS stop, unit, len(string_split(unit, ' ')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n
  FROM placed WHERE unit <> ''
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, n) AS nth FROM u) WHERE nth > 1
), run AS (
  SELECT doc_id, min(start) AS a, max(stop) AS b
  FROM (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM later)
  GROUP BY doc_id, g HAVING sum(words) >= {RUN_WORDS}
), cut AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS free FROM run
), by_doc AS (
  SELECT doc_id, count(*) AS n, sum(b - a) AS chars, max(b) AS upto,
         string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(b AS BIGINT) AS VARCHAR), ',' ORDER BY a)
           AS removed,
         string_agg(substring(d.text, CAST(free AS BIGINT) + 1, CAST(a - free AS BIGINT)), '' ORDER BY a) AS kept
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS chars_removed,
       coalesce(removed, '') AS removed,
       sha256(coalesce(kept, '') || substring(d.text, CAST(coalesce(upto, 0) AS BIGINT) + 1)) AS kept_sha256
FROM d LEFT JOIN by_doc USING (doc_id)
"""
