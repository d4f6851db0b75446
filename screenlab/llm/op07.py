"""Query over `documents`: licence scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import table
from screenlab.llm.licences import fit, scan

NAME = "op7_licence_scan"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines or runs of lines state a licence, which (line:family or line-last:family), and the families."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    def named(x: Column) -> Column:
        span = F.when(x["last"] > x["line"], F.concat_ws("-", x["line"], x["last"])).otherwise(x["line"].cast("string"))
        return F.concat_ws(":", span, x["family"])

    lines = F.transform("found", named)
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("found").cast("long").alias("n_lines"),
        F.array_join(lines, ",").alias("lines"),
        F.array_join(families, ",").alias("families"),
    )
