"""Reading tables whose rows are expensive to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt_out(df: DataFrame) -> DataFrame:
    """A file-based frame with at least one task per core.

    A long text costs far more to process than to move, so a table that is read
    in fewer tasks than there are cores is dealt out once, round robin.  Only the
    number of tasks is looked at, on the driver; rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def read_embeddings(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """An embedding table as (id, vec)."""
    return spark.read.parquet(path).select(F.col(key).alias("id"), F.col(vector).alias("vec"))
