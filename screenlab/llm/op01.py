"""Query over `pages`: URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import table
from screenlab.llm.url_filter import UrlRule, judge_urls

NAME = "op1_url_filter"
SQL = None

#: The rules of the contract (fixed values).
RULES = [
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select(
        F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "ratio", "probability"
    )
