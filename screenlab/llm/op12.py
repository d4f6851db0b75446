"""Query over `embeddings`: vector code compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.codes import vector_codes
from screenlab.llm.common import shared_folder, table, written

NAME = "op12_vector_codes"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    coded, books = vector_codes(vectors)
    digit = F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    rows = coded.select(
        F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), F.array_join(digit, "").alias("code"), "error"
    )
    rows = written(rows, shared_folder(spark), "codes")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


def _round(k: int) -> str:
    """The entries after round k, from those before it."""
    return rf"""
near{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * 1024 + e) AS e, min(d) AS d FROM (
    SELECT s.r, s.p, b.e, CAST(s.xx - 2 * list_inner_product(s.x, b.x) + b.xx AS BIGINT) AS d
    FROM part s JOIN book{k} b ON s.p = b.p
  ) GROUP BY r, p
), mean{k} AS (
  SELECT p, e, list(m ORDER BY j) AS x FROM (
    SELECT n.p, n.e, j, floor(sum(s.x[j]) / count(*)) AS m
    FROM near{k} n JOIN part s ON s.r = n.r AND s.p = n.p, range(1, 17) t(j) GROUP BY n.p, n.e, j
  ) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, x, list_inner_product(x, x) AS xx
  FROM (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)
),"""


#: Sums of squares of these integers are exact in double precision.
SQL = rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, x) AS r, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
  )
), part AS MATERIALIZED (
  SELECT r, p, x, list_inner_product(x, x) AS xx
  FROM (SELECT r, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM v, range(0, 4) t(p))
), book0 AS (
  SELECT p, r - 1 AS e, x, xx FROM part WHERE r <= 256
),{"".join(map(_round, range(4)))}
near4 AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * 1024 + e) AS e, min(d) AS d FROM (
    SELECT s.r, s.p, b.e, CAST(s.xx - 2 * list_inner_product(s.x, b.x) + b.xx AS BIGINT) AS d
    FROM part s JOIN book4 b ON s.p = b.p
  ) GROUP BY r, p
), coded AS (
  SELECT r, string_agg(format('{{:02x}}', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near4 GROUP BY r
), told AS (
  SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM book4)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (r), told
"""
