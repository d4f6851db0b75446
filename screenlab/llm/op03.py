"""Query over `documents`: token counts by the word-end vocabulary."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from screenlab.llm.common import table
from screenlab.llm.token_counts import token_counts

NAME = "op3_token_counts"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
