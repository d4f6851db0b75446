"""Query over `documents`: byte-level BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.bpe import round_trip
from screenlab.llm.common import table

NAME = "op5_byte_bpe"
SQL = None


def coded(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of each document."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = round_trip(docs.select("doc_id", "text"), path, pattern)
    n = F.size("ids").cast("long").alias("n_tokens")
    return out.select(F.col("row.doc_id").alias("doc_id"), "ids", n, "ids_sha256", "decoded_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents")).drop("ids")
