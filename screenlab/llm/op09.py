"""Query over `documents`: quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenlab.llm.common import table
from screenlab.llm.rules import RULES, STOP_WORDS, judge

NAME = "op9_quality_rules"

_COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*_COLUMNS)


def _sql() -> str:
    tests = []
    for r in RULES:
        if r.low is not None:
            tests.append(f"coalesce({r.value} >= {r.low}, true)")
        if r.high is not None:
            tests.append(f"coalesce({r.value} <= {r.high}, true)")
    stop = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    blank = r"[^\x20\x09-\x0D]"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), s AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '{blank}+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS l
  FROM t
), w8 AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM w8) WHERE n > 1
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS k FROM again) GROUP BY r
), m AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
    len(list_filter(w, lambda x: suffix(x, '!!'))) AS n_shouts,
    len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS n_echoes,
    len(list_filter(l, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS n_ellipsis_lines,
    len(list_filter(l, lambda x: ltrim(x, ' ') LIKE '-%' OR ltrim(x, ' ') LIKE '•%'
                                 OR ltrim(x, ' ') LIKE '* %')) AS n_bullet_lines
  FROM s LEFT JOIN covered ON covered.r = s.r
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT {", ".join(_COLUMNS[:-1])}, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
"""


SQL = _sql()
