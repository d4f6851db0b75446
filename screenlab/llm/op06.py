"""Query over `documents` and `labels`: quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import fold, table
from screenlab.llm.quality import fit_quality, score_quality

NAME = "op6_quality_classifier"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(F.col("row.doc_id")) == 1, F.lit(False))
    return score_quality(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted"
    )
