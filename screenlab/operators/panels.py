"""Expression-panel features.

A panel is long: (gene, sample, value), one row per gene and sample.  A gene has
at most as many rows as the panel has samples, a list fixed by the experiment,
so a gene's values may be held in one array or window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlab.functions import maths as fm
from screenlab.operators.metrics import guarded_corr
from screenlab.operators.ordered import with_rank


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return F.coalesce(F.try_divide(_total(a), F.size(a)), F.lit(0.0))


def _std(a: Column, mean: Column) -> Column:
    square = _total(F.transform(a, lambda x: (x - mean) * (x - mean)))
    return F.sqrt(F.coalesce(F.try_divide(square, F.size(a)), F.lit(0.0)))


def _count(a: Column) -> Column:
    return F.size(a).cast("double")


def as_arrays(panel: DataFrame, samples: Sequence[str], out: str = "values") -> DataFrame:
    """One row per gene with its values in sample order, missing and negative as 0."""
    cells = [
        F.coalesce(F.max(F.when(F.col("sample") == s, fm.number(F.col("value")))), F.lit(0.0))
        for s in samples
    ]
    return panel.groupBy("gene").agg(
        F.array(*[F.greatest(c, F.lit(0.0)) for c in cells]).alias(out)
    )


def specificity(panel: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Eleven contrasts of each sample against the gene's whole panel."""
    v, m, i = F.col("v"), F.col("m"), F.col("i")
    rows = as_arrays(panel, samples, "v").select("gene", "v", F.posexplode("v").alias("i", "m"))
    others = F.filter(v, lambda x, j: j != i)
    named = rows.select(
        "gene",
        F.get(F.array(*[F.lit(s) for s in samples]), i).alias("sample"),
        "v",
        "m",
        others.alias("o"),
        F.transform(others, F.log1p).alias("ol"),
        _total(v).alias("sum"),
        _mean(v).alias("mean"),
        F.array_max(v).alias("top"),
    )
    n = F.size("v")
    positive = F.filter(v, lambda x: x > 0)
    shares = F.transform(positive, lambda x: x / F.col("sum"))
    entropy = -_total(F.transform(shares, lambda p: p * F.log(p)))
    tau = _total(F.transform(v, lambda x: 1.0 - x / F.col("top"))) / F.greatest(n - 1, F.lit(1))
    return named.select(
        "gene",
        "sample",
        F.log1p(m).alias("matched_log"),
        _mean(F.col("ol")).alias("other_mean_log"),
        F.coalesce(F.array_max("ol"), F.lit(0.0)).alias("other_max_log"),
        F.log2((m + 0.1) / (_mean(F.col("o")) + 0.1)).alias("matched_vs_other_log2_ratio"),
        fm.safe_ratio(m, F.col("sum")).alias("matched_fraction"),
        (_count(F.filter(v, lambda x: x <= m)) / n).alias("matched_within_gene_percentile"),
        fm.safe_ratio(_std(v, F.col("mean")), F.col("mean")).alias("cross_cell_cv"),
        F.when(F.col("top") > 0, tau).otherwise(F.lit(0.0)).alias("cross_cell_tau"),
        F.when(F.col("sum") > 0, entropy / F.log(F.greatest(n, F.lit(2)).cast("double")))
        .otherwise(F.lit(0.0))
        .alias("cross_cell_entropy"),
        _count(positive).alias("expressing_cell_count"),
        _count(F.filter(v, lambda x: x >= 1)).alias("cell_count_tpm_ge_1"),
    )


def global_percentile(panel: DataFrame) -> DataFrame:
    """Percentile of each value among all genes of its sample, ties averaged."""
    return with_rank(panel, ["sample"], "value", "global_percentile", pct=True)


def own_expression(
    rows: DataFrame, total: DataFrame, mrna: DataFrame, samples: Sequence[str]
) -> DataFrame:
    """Six columns per (gene, sample) row: own levels, panel mean, breadth, specificity.

    ``missing`` is 1 where the gene is in no panel; its values are 0.
    """
    a = as_arrays(total, samples, "_t")
    b = as_arrays(mrna, samples, "_m")
    joined = rows.join(a, "gene", "left").join(b, "gene", "left")
    at = F.array_position(F.array(*[F.lit(s) for s in samples]), F.col("sample")).cast("int") - 1
    zero = F.lit(0.0)
    own = F.coalesce(F.when(at >= 0, F.get("_t", at)), zero)
    own_m = F.coalesce(F.when(at >= 0, F.get("_m", at)), zero)
    mean = F.coalesce(_mean(F.col("_t")), zero)
    breadth = F.coalesce(_count(F.filter("_t", lambda x: x >= 1)), zero)
    known = F.col("_t").isNotNull()
    return joined.select(
        *rows.columns,
        F.log1p(own).alias("log_tpm_own_total"),
        F.log1p(own_m).alias("log_tpm_own_mrna"),
        F.log1p(mean).alias("log_tpm_panel_mean"),
        F.when(known, breadth).otherwise(zero).alias("tpm_breadth"),
        (own / (mean + 1e-6)).alias("tpm_specificity"),
        (own >= 1).cast("double").alias("tpm_expressed"),
        (~known).cast("double").alias("missing"),
    )


def matched_expression(
    rows: DataFrame, total: DataFrame, mrna: DataFrame, samples: Sequence[str]
) -> DataFrame:
    """Log levels and presence per sample, and the row's own levels against the maximum."""
    a = as_arrays(total, samples, "_t")
    b = as_arrays(mrna, samples, "_m")
    joined = rows.join(a, "gene", "left").join(b, "gene", "left")
    zero = F.lit(0.0)

    def at(col: str, i: int) -> Column:
        return F.coalesce(F.get(col, F.lit(i)), zero)

    out = []
    for i, s in enumerate(samples):
        out += [
            F.log1p(at("_t", i)).alias(f"total_log_{s}"),
            (at("_t", i) > 0).cast("double").alias(f"total_present_{s}"),
            F.log1p(at("_m", i)).alias(f"mrna_log_{s}"),
            (at("_m", i) > 0).cast("double").alias(f"mrna_present_{s}"),
        ]
    where = F.array_position(F.array(*[F.lit(s) for s in samples]), F.col("sample")).cast("int") - 1
    t = F.log1p(F.coalesce(F.when(where >= 0, F.get("_t", where)), zero))
    m = F.log1p(F.coalesce(F.when(where >= 0, F.get("_m", where)), zero))
    tmax = F.log1p(F.coalesce(F.array_max("_t"), zero))
    mmax = F.log1p(F.coalesce(F.array_max("_m"), zero))
    return joined.select(
        *rows.columns,
        *out,
        t.alias("matched_total_log"),
        m.alias("matched_mrna_log"),
        (m - t).alias("matched_mrna_minus_total"),
        fm.safe_ratio(t, tmax).alias("matched_total_fraction_max"),
        fm.safe_ratio(m, mmax).alias("matched_mrna_fraction_max"),
    )


def neighbour_profile(rows: DataFrame, panel: DataFrame, samples: Sequence[str]) -> DataFrame:
    """A neighbouring gene's values: the row's own sample, every sample, and their spread.

    rows(..., neighbour, sample).  Missing values are left out of the spread and
    flagged; they read as 0 elsewhere.
    """
    cells = [F.max(F.when(F.col("sample") == s, F.col("value"))).alias(f"_{s}") for s in samples]
    wide = panel.groupBy(F.col("gene").alias("neighbour")).agg(*cells)
    joined = rows.join(wide, "neighbour", "left")
    values = F.array(*[F.col(f"_{s}") for s in samples])
    known = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    names = F.array(*[F.lit(s) for s in samples])
    where = F.array_position(names, F.col("sample")).cast("int") - 1
    own = F.when(where >= 0, F.get(values, where))
    zero = F.lit(0.0)
    mean = _mean(known)
    return joined.select(
        *rows.columns,
        F.coalesce(own, zero).alias("matched"),
        own.isNull().cast("double").alias("matched_missing"),
        *[F.coalesce(F.col(f"_{s}"), zero).alias(f"value_{s}") for s in samples],
        mean.alias("value_mean"),
        F.coalesce(F.array_min(known), zero).alias("value_min"),
        F.coalesce(F.array_max(known), zero).alias("value_max"),
        _std(known, mean).alias("value_std"),
    )


def profile(panel: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Per (gene, sample): the gene's log profile, the own level and its deviation."""
    logs = as_arrays(panel, samples, "_v").select("gene", F.transform("_v", F.log1p).alias("l"))
    l = F.col("l")
    mean = _mean(l)
    each = logs.select(
        "gene",
        mean.alias("log_mean"),
        F.array_max(l).alias("log_max"),
        F.array_min(l).alias("log_min"),
        _std(l, mean).alias("log_std"),
        _count(F.filter(l, lambda x: x > F.log1p(F.lit(1.0)))).alias("expressed"),
        F.posexplode(l).alias("i", "own_log"),
    )
    return each.select(
        "gene",
        F.get(F.array(*[F.lit(s) for s in samples]), F.col("i")).alias("sample"),
        "log_mean",
        "log_max",
        "log_min",
        "log_std",
        "expressed",
        "own_log",
        (F.col("own_log") - F.col("log_mean")).alias("own_deviation"),
    )


# ---- developmental atlas: (gene, organ, stage, value) ---------------------------------


def developmental(atlas: DataFrame, postnatal: Sequence[str]) -> DataFrame:
    """Level, breadth and timing of each gene over organs and stages."""
    rk = fm.stage_rank(F.col("stage"), postnatal)
    rows = atlas.select(
        "gene", "organ", "stage", "value", F.log1p("value").alias("lg"), rk.alias("rk")
    )
    ends = rows.agg(F.min("rk").alias("lo"), F.max("rk").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    axis = F.try_divide(F.col("rk") - lo, hi - lo)
    prenatal = F.lower("stage").endswith("wpc")
    # highest level first, earliest stage on a tie
    peak = F.min(F.struct((-F.col("lg")).alias("l"), F.col("axis")))["axis"]
    per = rows.withColumn("axis", axis).groupBy("gene").agg(
        F.avg("lg").alias("level_mean"),
        F.max("lg").alias("level_max"),
        F.percentile("lg", 0.9).alias("level_p90"),
        F.stddev_pop("lg").alias("level_sd"),
        F.avg((F.col("value") > 1).cast("double")).alias("breadth_share"),
        F.avg(F.when(prenatal, F.col("lg"))).alias("prenatal"),
        F.avg(F.when(~prenatal, F.col("lg"))).alias("postnatal"),
        peak.alias("peak"),
    )
    organs = (
        organ_levels(atlas)
        .groupBy("gene")
        .agg(F.count_if(F.col("median") > 1).cast("double").alias("breadth_organs"))
    )
    return per.join(organs, "gene").select(
        "*", (F.col("prenatal") - F.col("postnatal")).alias("timing_difference")
    )


def organ_levels(atlas: DataFrame) -> DataFrame:
    return atlas.groupBy("gene", "organ").agg(
        F.median("value").alias("median"), F.median(F.log1p("value")).alias("log_median")
    )


def coexpression(
    atlas: DataFrame, markers: Sequence[int], by_organ: bool = False, minimum: int = 3
) -> DataFrame:
    """Spearman of every gene against each marker gene over the samples both have.

    NULL for a constant side or fewer than ``minimum`` samples.  The markers'
    rows are as many as the atlas has samples.
    """
    marker = atlas.where(F.col("gene").isin(*markers)).select(
        F.col("gene").alias("marker"), "organ", "stage", F.col("value").alias("mv")
    )
    pairs = atlas.join(marker, ["organ", "stage"])
    by = ["gene", "marker", "organ"] if by_organ else ["gene", "marker"]
    group = Window.partitionBy(*by)

    def rank(value: str) -> Column:
        first = F.rank().over(group.orderBy(value))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
        return first + (ties - 1) / 2.0

    ranked = pairs.select(*by, rank("value").alias("ra"), rank("mv").alias("rb"))
    n = F.count(F.lit(1))
    rho = F.when(n >= minimum, guarded_corr(F.col("ra"), F.col("rb")))
    return ranked.groupBy(*by).agg(n.alias("samples"), rho.alias("rho"))
