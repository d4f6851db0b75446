"""Ranking, threshold and regression metrics, grouped, with exact tie handling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.operators.ordered import null_safe_join, running_sums, with_rank


def score_table(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per (by, score) with row count ``n`` and positives ``pos``."""
    return df.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )


def curve_points(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """ROC / precision-recall points, one per distinct score, highest first."""
    ran = running_sums(score_table(df, by, score, label), by, score, ["n", "pos"], True)
    fp = F.col("run_n") - F.col("run_pos")
    negatives = F.col("all_n") - F.col("all_pos")
    return ran.select(
        *by,
        score,
        "n",
        "pos",
        F.col("run_n").alias("cum_n"),
        F.col("run_pos").alias("tp"),
        fp.alias("fp"),
        F.col("all_n").alias("group_n"),
        F.col("all_pos").alias("group_pos"),
        F.try_divide(F.col("run_pos"), F.col("all_pos")).alias("tpr"),
        F.try_divide(fp, negatives).alias("fpr"),
        (F.col("run_pos") / F.col("run_n")).alias("precision"),
    )


def ranking_metrics(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """n, n_pos, AUROC (Mann-Whitney) and average precision; NULL for a single class.

    Average precision takes a whole group of tied scores as one step.
    """
    return ranking_from_table(score_table(df, by, score, label), by, score)


def threshold_metrics(
    df: DataFrame, by: Sequence[str], score: str, label: str, threshold: float = 0.5
) -> DataFrame:
    """Precision, recall, F1 and accuracy at a threshold; 0 where undefined."""
    said = F.col(score) >= threshold
    true = F.col(label) == 1
    zero = F.lit(0.0)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(true).alias("n_pos"),
        F.count_if(said & true).alias("_tp"),
        F.count_if(said).alias("_said"),
        F.count_if(said == true).alias("_right"),
    )
    tp = F.col("_tp")
    return counts.select(
        *by,
        "n",
        "n_pos",
        F.try_divide(F.col("n_pos"), F.col("n")).alias("pos_rate"),
        F.coalesce(F.try_divide(tp, F.col("_said")), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("n_pos")), zero).alias("recall"),
        F.coalesce(F.try_divide(tp * 2.0, F.col("_said") + F.col("n_pos")), zero).alias("f1"),
        F.try_divide(F.col("_right"), F.col("n")).alias("accuracy"),
    )


def classification_metrics(
    df: DataFrame, by: Sequence[str], score: str, label: str, threshold: float = 0.5
) -> DataFrame:
    ranked = ranking_metrics(df, by, score, label).select(*by, "auroc", "auprc")
    return null_safe_join(threshold_metrics(df, by, score, label, threshold), ranked, by)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL when either side is constant.

    ``corr`` throws on constant input under ANSI mode.  The spread is compared
    with the size of the values, since the sums may leave a speck of rounding.
    """
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    spread = (sx > F.max(F.abs(x)) * 1e-12) & (sy > F.max(F.abs(y)) * 1e-12)
    return F.when(spread, F.try_divide(F.covar_pop(x, y), sx * sy))


def regression_metrics(df: DataFrame, by: Sequence[str], truth: str, pred: str) -> DataFrame:
    """n, Pearson, Spearman, RMSE, MAE and R2 (NULL for a constant truth)."""
    t, p = F.col(truth), F.col(pred)
    ranked = with_rank(with_rank(df, by, truth, "_rt"), by, pred, "_rp")
    spread = F.var_pop(t) * F.count(F.lit(1))
    flat = F.stddev_pop(t) <= F.max(F.abs(t)) * 1e-12
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        guarded_corr(t, p).alias("pearson_r"),
        guarded_corr(F.col("_rt"), F.col("_rp")).alias("spearman_rho"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.when(~flat, F.lit(1.0) - F.try_divide(F.sum((t - p) * (t - p)), spread)).alias("r2"),
    )


def over_sets(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows once per grouping set, with ``split`` naming the set.

    Meant for frames already reduced to one row per (columns, score): what is
    repeated then is the reduced frame, not the input.
    """
    names = sorted({c for s in sets for c in s})
    rows = []
    for s in sets:
        kept = [
            (F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c)
            for c in names
        ]
        rows.append(F.struct(F.lit("+".join(s) or "overall").alias("split"), *kept))
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode(F.array(*rows)).alias("_s")).select(*rest, "_s.*")


def ranking_metrics_by_sets(
    df: DataFrame, sets: Sequence[Sequence[str]], score: str, label: str
) -> DataFrame:
    """Ranking metrics for every grouping set in one pass over the rows."""
    names = sorted({c for s in sets for c in s})
    reduced = score_table(df, names, score, label)
    spread = over_sets(reduced, sets)
    by = ["split", *names]
    merged = spread.groupBy(*by, score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return ranking_from_table(merged, by, score)


def ranking_from_table(table: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Ranking metrics from a score table (by, score, n, pos)."""
    ran = running_sums(table, by, score, ["n", "pos"], True)
    neg = F.col("n") - F.col("pos")
    passed = F.col("run_n") - F.col("run_pos")
    beaten = (F.col("all_n") - F.col("all_pos") - passed) + neg / F.lit(2.0)
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return (
        ran.groupBy(*by)
        .agg(
            F.max("all_n").alias("n"),
            F.max("all_pos").alias("n_pos"),
            F.sum(F.col("pos") * beaten).alias("_u"),
            F.sum(F.col("pos") * (F.col("run_pos") / F.col("run_n"))).alias("_ap"),
        )
        .select(
            *by,
            "n",
            "n_pos",
            F.when(
                both, F.try_divide(F.col("_u"), F.col("n_pos") * (F.col("n") - F.col("n_pos")))
            ).alias("auroc"),
            F.when(both, F.try_divide(F.col("_ap"), F.col("n_pos"))).alias("auprc"),
        )
    )


def effect_size(df: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """Mann-Whitney U / (n m), group means, and the two-sided normal p-value."""
    table = score_table(df, by, value, label)
    ties = F.col("n").cast("double")
    per = table.groupBy(*by).agg(
        F.sum(ties * ties * ties - ties).alias("_t"),
        F.try_divide(F.sum(F.col(value) * F.col("pos")), F.sum("pos")).alias("mean_hit"),
        F.try_divide(
            F.sum(F.col(value) * (F.col("n") - F.col("pos"))), F.sum(F.col("n") - F.col("pos"))
        ).alias("mean_rest"),
    )
    ranked = ranking_from_table(table, by, value)
    a = F.col("n_pos").cast("double")
    b = (F.col("n") - F.col("n_pos")).cast("double")
    n = F.col("n").cast("double")
    sd = F.sqrt(a * b / 12.0 * ((n + 1.0) - F.try_divide(F.col("_t"), n * (n - 1.0))))
    z = F.try_divide(F.abs(F.col("auroc") * a * b - a * b / 2.0) - 0.5, sd)
    joined = null_safe_join(ranked, per, by)
    return joined.select(
        *by,
        "n",
        "n_pos",
        "auroc",
        "mean_hit",
        "mean_rest",
        normal_two_sided(F.greatest(z, F.lit(0.0))).alias("p_value"),
    )


def normal_two_sided(z: Column) -> Column:
    """2 (1 - Phi(z)) for z >= 0, right to about twelve digits of itself however small.

    Up to 2 by the series of the error function, whose terms are all positive,
    beyond by the continued fraction of its complement.
    """
    x = z / F.lit(2.0**0.5)
    terms = F.sequence(F.lit(1), F.lit(80))
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(a: Column, k: Column) -> Column:
        term = a["term"] * 2.0 * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    scale = F.exp(-x * x) / F.lit(math.pi**0.5)
    near = 1.0 - 2.0 * scale * F.aggregate(terms, start, add, lambda a: a["total"])
    far = F.greatest(x, F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), far, lambda f, k: far + k / 2.0 / f)
    return F.when(x < 1.4, near).otherwise(scale / fraction)


# Metrics a run may be tuned on, by name: each gives the named column per group.
METRICS = {
    "auroc": ranking_metrics,
    "auprc": ranking_metrics,
    "pearson_r": regression_metrics,
    "spearman_rho": regression_metrics,
    "rmse": regression_metrics,
    "mae": regression_metrics,
}


def metric(
    df: DataFrame, name: str, by: Sequence[str], score: str, label: str
) -> DataFrame:
    """(by, value) of one metric chosen by name."""
    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}, have {sorted(METRICS)}")
    ranking = METRICS[name] is ranking_metrics
    out = METRICS[name](df, by, score, label) if ranking else METRICS[name](df, by, label, score)
    return out.select(*by, F.col(name).alias("value"))
