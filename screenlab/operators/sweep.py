"""Summaries over a long table of sweep results (config, fold, seed, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = 0.02


def config_summary(results: DataFrame, reference: str) -> DataFrame:
    """Mean and sd per config, difference to the reference, and whether it is noise."""
    per = results.groupBy("config").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
        F.count(F.lit(1)).alias("runs"),
    )
    base = per.where(F.col("config") == reference).select("mean").scalar()
    delta = F.col("mean") - F.col("_base")
    return per.select("*", base.alias("_base")).select(
        "config",
        "mean",
        "sd",
        "runs",
        delta.alias("delta"),
        ((F.abs(delta) < NOISE) & (F.col("config") != reference)).alias("noise"),
    )


def paired_comparison(results: DataFrame, reference: str) -> DataFrame:
    """Wins over the reference in the same (fold, seed), and whether folds agree in sign."""
    base = results.where(F.col("config") == reference).select(
        "fold", "seed", F.col("value").alias("_base")
    )
    pairs = results.where(F.col("config") != reference).join(base, ["fold", "seed"])
    per_fold = pairs.groupBy("config", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value") > F.col("_base")).alias("w"),
        (F.avg("value") - F.avg("_base")).alias("d"),
    )
    return per_fold.groupBy("config").agg(
        F.sum("w").alias("wins"),
        F.sum("n").alias("pairs"),
        F.min("d").alias("lowest_delta"),
        F.max("d").alias("highest_delta"),
        (~((F.min("d") < 0) & (F.max("d") > 0))).alias("sign_consistent"),
    )


def folds_won(results: DataFrame) -> DataFrame:
    """How many folds each config leads; the first name wins a tie."""
    means = results.groupBy("config", "fold").agg(F.avg("value").alias("m"))
    best = means.groupBy("fold").agg(
        F.min(F.struct((-F.col("m")).alias("m"), "config")).alias("b")
    )
    won = best.groupBy(F.col("b.config").alias("config")).agg(F.count(F.lit(1)).alias("won"))
    overall = means.groupBy("config").agg(F.avg("m").alias("mean"))
    return overall.join(won, "config", "left").select(
        "config", "mean", F.coalesce("won", F.lit(0)).alias("won")
    )


def trial_summary(results: DataFrame, size: str) -> DataFrame:
    """Mean and sample sd over folds per trial, and the median of a size column.

    A trial has one row per fold, so its values fit one task.
    """
    return results.groupBy("config").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.median(size).alias(f"median_{size}"),
        F.count(F.lit(1)).alias("folds"),
    )


def best_trial(results: DataFrame, size: str) -> DataFrame:
    """The trial with the highest mean, ties to the first name."""
    per = trial_summary(results, size)
    return per.orderBy(F.desc("mean"), "config").limit(1)


def run_sweep(
    configs: Iterable[str],
    folds: Iterable[str],
    seeds: Iterable[int],
    fit_and_score: Callable[[str, str, int], DataFrame],
) -> DataFrame:
    """Every (config, fold, seed) scored by a job of its own, as one long table.

    ``fit_and_score`` returns a one-row frame with ``value``.
    """
    folds, seeds = list(folds), list(seeds)
    out = None
    for config in configs:
        for fold in folds:
            for seed in seeds:
                row = fit_and_score(config, fold, seed).select(
                    F.lit(config).alias("config"),
                    F.lit(fold).alias("fold"),
                    F.lit(seed).alias("seed"),
                    F.col("value").cast("double").alias("value"),
                )
                out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("an empty sweep has no results")
    return out
