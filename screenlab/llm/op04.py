"""Query over `pages` and `documents`: language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import table
from screenlab.llm.language import identify, text_model
from screenlab.llm.url_filter import host_of

NAME = "op4_language_id"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page and one per document; the other one's id is null.

    Documents teach the text model, outside the held-out fold, and are then
    identified like pages, by text and source alone.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    no_id = F.lit(None).cast("long")
    texts = docs.select("doc_id", no_id.alias("page_id"), F.col("source").alias("host"), "text")
    html = pages.select(
        no_id.alias("doc_id"), "page_id", host_of(F.col("url")).alias("host"), F.col("html").alias("text")
    )
    found = identify(texts, html, text_model(docs))
    return found.select("doc_id", "page_id", "host", "declared", "lang", "text_lang", F.round("p", 6).alias("p"))
