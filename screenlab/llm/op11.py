"""Query over `documents`: periodic run detection, runs being planted in every tenth document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import table
from screenlab.llm.periodic import WORD, find_runs

NAME = "op11_periodic_runs"


def planted(doc_id: Column, text: Column) -> Column:
    """The text; where crc32 of the id ends in 0, its words from some place on repeat a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        told = F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(told, " ")).otherwise(F.lit(""))

    # The words are bound once, outside of what is done for each.
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.when(h % 10 == 0, F.get(F.transform(words, repeated), 0)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), texts=False)
    steeper = F.aggregate(
        "runs",
        F.get("runs", 0),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        steeper.alias("_best"),
        F.sha2(told, 256).alias("runs_sha256"),
        "collapsed_sha256",
    ).select(
        "doc_id",
        "n_runs",
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_reduce(
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda crc, c: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)),
           4294967295
         ) AS crc
  FROM documents
), h AS (
  SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(crc, 4294967295) AS h FROM d
), g AS (
  SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h
), word AS (
  SELECT r, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS x
  FROM (SELECT *, unnest(range(0, n)) AS i FROM g)
), equal AS (
  SELECT s.r, t.i - s.i AS q, s.i FROM word s JOIN word t ON s.r = t.r AND s.x = t.x AND t.i > s.i
  JOIN g ON g.r = s.r AND 3 * (t.i - s.i) <= g.n
), island AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM equal
), stretch AS (
  SELECT r, q, min(i) AS b, count(*) + q AS l FROM island GROUP BY r, q, k
), run AS (
  SELECT r, b, l, min(q) AS q FROM stretch WHERE l >= greatest(24, 3 * q) GROUP BY r, b, l
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(b || ',' || l || ',' || q || chr(10), '' ORDER BY b, q) AS runs
  FROM run GROUP BY r
), best AS (
  SELECT r, b, l, q, row_number() OVER (PARTITION BY r ORDER BY l / q DESC, b, q) AS k FROM run
), dropped AS (
  SELECT DISTINCT r, unnest(range(b + q, b + l)) AS i FROM run
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b AS BIGINT) AS "start",
       CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM g LEFT JOIN told USING (r) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (r) LEFT JOIN kept USING (r)
"""
