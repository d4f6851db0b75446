"""Query over `documents`: sentence-piece encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import table
from screenlab.llm.pieces import round_trip

NAME = "op13_sentence_pieces"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
