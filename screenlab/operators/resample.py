"""Class balancing and row weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlab.functions import maths as fm
from screenlab.operators import neighbours
from screenlab.operators.ordered import row_numbers


def _counts(df: DataFrame, label: str) -> tuple[Column, Column]:
    one = df.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return one.select("pos").scalar(), one.select("neg").scalar()


def under_sample(df: DataFrame, label: str, order: str, ratio: float = 1.0) -> DataFrame:
    """Keep n_pos / ratio negatives, the first in the order of a shuffled unique key."""
    pos, _ = _counts(df, label)
    limit = F.floor(pos / F.lit(float(ratio)))
    rn = row_numbers(df, [label], order, "_rn").withColumn("_limit", limit)
    return rn.where((F.col(label) == 1) | (F.col("_rn") <= F.col("_limit"))).select(*df.columns)


def over_sample(df: DataFrame, label: str, order: str, ratio: float = 1.0) -> DataFrame:
    """Repeat positives up to ratio x n_neg, evenly: no row has two copies more than another."""
    pos, neg = _counts(df, label)
    rn = row_numbers(df, [label], order, "_rn").select(
        "*", F.floor(neg * F.lit(float(ratio))).alias("_want"), pos.alias("_pos")
    )
    whole = F.floor(F.try_divide(F.col("_want"), F.col("_pos")))
    extra = (F.col("_rn") <= F.col("_want") - whole * F.col("_pos")).cast("int")
    copies = F.when(F.col(label) == 1, F.greatest(whole + extra, F.lit(1))).otherwise(F.lit(1))
    return rn.select(*df.columns, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(
        *df.columns
    )


METHODS: dict[str, Callable[..., DataFrame]] = {
    "none": lambda df, label, order, ratio=1.0: df,
    "random_under": under_sample,
    "random_over": over_sample,
    # These two work on the column `features` of a design.
    "smote": neighbours.smote_rows,
    "smote_tomek": neighbours.smote_tomek_rows,
}


def resample(df: DataFrame, method: str, label: str, order: str, ratio: float = 1.0) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown resampling {method!r}, have {sorted(METHODS)}")
    return METHODS[method](df, label, order, ratio)


def bagging_samples(
    df: DataFrame, label: str, key: str, estimators: int, ratio: float = 1.0, seed: int = 0
) -> DataFrame:
    """Per estimator: every positive and ratio x n_pos negatives drawn without replacement."""
    pos, _ = _counts(df, label)
    limit = F.floor(pos * F.lit(float(ratio)))
    ids = F.array(*[F.lit(i) for i in range(estimators)])
    spread = df.select("*", F.explode(ids).alias("estimator"))
    shuffled = spread.withColumn("_h", F.xxhash64(F.col(key), "estimator", F.lit(seed)))
    positives = shuffled.where(F.col(label) == 1)
    negatives = row_numbers(shuffled.where(F.col(label) == 0), ["estimator"], "_h", "_rn")
    kept = negatives.withColumn("_limit", limit).where(F.col("_rn") <= F.col("_limit"))
    cols = [*df.columns, "estimator"]
    return positives.select(*cols).unionByName(kept.select(*cols))


# ---- weights -------------------------------------------------------------------------


def _normalised(cells: DataFrame, raw: Column) -> DataFrame:
    """Weights with mean 1 over the source cells (a row per cell)."""
    every = Window.partitionBy(F.lit(0))
    rows = cells.select("cell", raw.alias("_raw"))
    return rows.select(
        "cell",
        (F.col("_raw") / F.sum("_raw").over(every) * F.count(F.lit(1)).over(every)).alias("weight"),
    )


def uniform_weights(cells: DataFrame, target: str) -> DataFrame:
    return cells.where(F.col("cell") != target).select("cell", F.lit(1.0).alias("weight"))


def distance_weights(cells: DataFrame, target: str) -> DataFrame:
    """exp(-d / mean d) to the target cell's coordinates; cells(cell, vec)."""
    here = cells.where(F.col("cell") == target).select("vec").scalar()
    apart = cells.where(F.col("cell") != target).select("cell", "vec", here.alias("_here"))
    d = apart.select("cell", fm.euclidean(F.col("vec"), F.col("_here")).alias("_d"))
    mean = F.avg("_d").over(Window.partitionBy(F.lit(0)))
    scaled = d.select("cell", "_d", F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("_mean"))
    return _normalised(scaled, F.exp(-F.col("_d") / F.col("_mean")))


def group_weights(cells: DataFrame, target: str, ratio: float) -> DataFrame:
    """``ratio`` for cells of the target's lineage, 1 for others; cells(cell, lineage)."""
    here = cells.where(F.col("cell") == target).select("lineage").scalar()
    apart = cells.where(F.col("cell") != target).select("cell", "lineage", here.alias("_here"))
    same = F.col("lineage").eqNullSafe(F.col("_here"))
    return _normalised(apart, F.when(same, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def rate_weights(cells: DataFrame, target: str) -> DataFrame:
    """Inverse positive rate; cells(cell, rate)."""
    apart = cells.where(F.col("cell") != target)
    return _normalised(apart, F.lit(1.0) / F.greatest("rate", F.lit(1e-6)))


SCHEMES: dict[str, Callable[..., DataFrame]] = {
    "uniform": uniform_weights,
    "coordinates": distance_weights,
    "lineage": group_weights,
    "posrate": rate_weights,
}


def control_weight(df: DataFrame, favoured: Column, weight: float, label: str) -> DataFrame:
    """One row: the factor on positives that gives the same positive rate as
    weighting the favoured rows by ``weight``, whoever they are."""
    w = F.when(favoured, F.lit(float(weight))).otherwise(F.lit(1.0))
    y = F.col(label).cast("double")
    rates = df.agg((F.sum(w * y) / F.sum(w)).alias("eff"), F.avg(y).alias("base"))
    odds = (F.col("eff") / (1 - F.col("eff"))) / (F.col("base") / (1 - F.col("base")))
    return rates.select("eff", "base", odds.alias("ratio"))


def class_weights(df: DataFrame, label: str, multiplier: float = 1.0) -> DataFrame:
    """Weight of a positive: 1, sqrt of the natural ratio, the ratio, each times ``multiplier``."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    ratio = F.coalesce(F.try_divide(F.col("n") - F.col("pos"), F.col("pos")), F.lit(1.0))
    kinds = F.array(
        F.struct(F.lit("one").alias("scheme"), F.lit(1.0).alias("w")),
        F.struct(F.lit("sqrt").alias("scheme"), F.sqrt(ratio).alias("w")),
        F.struct(F.lit("balanced").alias("scheme"), ratio.alias("w")),
    )
    return counts.select(F.explode(kinds).alias("x")).select(
        "x.scheme", (F.col("x.w") * float(multiplier)).alias("weight")
    )
