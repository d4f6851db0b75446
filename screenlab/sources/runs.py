"""Finished runs: pairs of an info record and its metric rows, by directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators.ordered import first_by


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(infos, metrics) of every run directory below ``folder``."""
    directory = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    infos = spark.read.json(f"{folder}/*/run_info.json", multiLine=True)
    metrics = spark.read.csv(f"{folder}/*/metrics.csv", header=True)
    return (
        infos.withColumn("run", directory),
        metrics.withColumn("run", directory),
    )


def complete_runs(infos: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric rows with their run's info; a run lacking either half is skipped."""
    return metrics.join(infos, "run")


def latest_runs(infos: DataFrame, by: Sequence[str]) -> DataFrame:
    """The run with the greatest name per group."""
    return infos.groupBy(*by).agg(F.max("run").alias("run"))


def pooled_against_own(
    pooled: DataFrame, own: DataFrame, group: str, metric: str
) -> DataFrame:
    """Per group: the pooled model's metric, the own model's, and the difference."""
    a = pooled.select(group, F.col("n").alias("n_test"), F.col(metric).alias(f"pooled_{metric}"))
    b = own.select(group, F.col(metric).alias(f"own_{metric}"))
    return a.join(b, group, "left").select(
        "*", (F.col(f"own_{metric}") - F.col(f"pooled_{metric}")).alias(f"delta_{metric}")
    )


def run_summary(metrics: DataFrame, splits: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per run: each value overall and per split in columns."""
    aggs = [
        F.max(F.when(F.col("split") == s, F.col(v))).alias(f"{v}_{s}")
        for s in splits
        for v in values
    ]
    return metrics.groupBy("run").agg(*aggs)


def keep_first(df: DataFrame, key: str, order: str, keep: Sequence[str]) -> DataFrame:
    return first_by(df, [key], [F.col(order)], list(keep))
