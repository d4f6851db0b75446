"""Combining several models' scores for the same keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.operators.ordered import with_rank


def coverage_problems(df: DataFrame, keys: Sequence[str], model: str, models: int) -> DataFrame:
    """Keys that some model lacks or holds more than once, with both counts.

    Rows are dealt out by key once, for both groupings: few rows are alike, so summing
    before the shuffle would only hold them all in a table of each task.
    """
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = df.select(*keys, model).repartition(parts, *keys).groupBy(*keys, model).agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("models"), F.max("n").alias("copies"))
        .where((F.col("models") != models) | (F.col("copies") > 1))
    )


def require_coverage(df: DataFrame, keys: Sequence[str], model: str, models: int) -> DataFrame:
    """``df`` itself, or an error naming a key that is not covered exactly once."""
    bad = coverage_problems(df, keys, model, models).take(3)
    if bad:
        raise ValueError(f"models do not cover the same keys once each, e.g. {bad}")
    return df


def _weight(weights: dict[str, float] | None, model: str) -> Column:
    if weights is None:
        return F.lit(1.0)
    pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
    return F.try_element_at(F.create_map(*pairs), F.col(model))


def rank_average(
    df: DataFrame,
    keys: Sequence[str],
    weights: dict[str, float] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Weighted mean of each model's percentile ranks (ties share a rank)."""
    ranked = with_rank(df, ["model", *within], "score", "_r", pct=True)
    w = _weight(weights, "model")
    return ranked.groupBy(*keys).agg(
        (F.sum(F.col("_r") * w) / F.sum(w)).alias("score"), F.count(F.lit(1)).alias("models")
    )


def _scaled(df: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """Rows with their model's summary attached.

    The summaries, one a model, are one value that every row looks its own up in:
    a join on the model would sort all rows of a model in one task.
    """
    per = df.groupBy("model").agg(*aggs)
    names = [c for c in per.columns if c != "model"]
    key = F.coalesce(F.concat(F.lit("="), F.col("model").cast("string")), F.lit(""))
    table = per.agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*names)))).alias("m")).scalar()
    found = df.select("*", F.try_element_at(table, key).alias("_found"))
    return found.select(*df.columns, *[F.col(f"_found.{n}").alias(n) for n in names])


def minmax_blend(df: DataFrame, keys: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Weighted sum of scores scaled to 0..1; a constant score has no scale: NULL."""
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError("blend weights must sum to 1")
    scaled = _scaled(df, [F.min("score").alias("_lo"), F.max("score").alias("_hi")])
    unit = F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return scaled.groupBy(*keys).agg(F.sum(unit * _weight(weights, "model")).alias("score"))


def zscores(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """Scores minus their model's mean over its sd; 0 when the sd is 0 and ``eps`` is 0."""
    scaled = _scaled(df, [F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s")])
    z = F.coalesce(
        F.try_divide(F.col("score") - F.col("_m"), F.col("_s") + F.lit(eps)), F.lit(0.0)
    )
    return scaled.select(*df.columns, z.alias("z"))


def zscore_mean(df: DataFrame, keys: Sequence[str], eps: float = 1e-12) -> DataFrame:
    """Mean z-score per key, rescaled to 0..1 over all keys."""
    mean = zscores(df, eps).groupBy(*keys).agg(F.avg("z").alias("z"))
    whole = mean.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    lo, hi = whole.select("lo").scalar(), whole.select("hi").scalar()
    return mean.select(*keys, F.try_divide(F.col("z") - lo, hi - lo).alias("score"))


def zscore_sum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return zscores(df).groupBy(*keys).agg(F.sum("z").alias("score"))


def fixed_blends(
    df: DataFrame, keys: Sequence[str], first: str, second: str, shares: Sequence[float]
) -> DataFrame:
    """Blends of two models' within-cell ranks, one row per share of the first."""
    ranked = with_rank(df, ["model", "cell"], "score", "_r", pct=True)
    both = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("model") == first, F.col("_r"))).alias("_a"),
        F.max(F.when(F.col("model") == second, F.col("_r"))).alias("_b"),
    )
    blends = [
        F.struct(
            F.lit(s).cast("double").alias("share"),
            (F.col("_a") * s + F.col("_b") * (1 - s)).alias("score"),
        )
        for s in shares
    ]
    return both.select(*keys, F.explode(F.array(*blends)).alias("x")).select(*keys, "x.*")
