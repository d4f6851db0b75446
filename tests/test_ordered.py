"""Order statistics against numpy, with ties, skew and NULL groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenlab.operators import metrics, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value most of that group."""
    rng = np.random.default_rng(1)
    big = pd.DataFrame({"g": "big", "v": np.where(rng.random(3000) < 0.4, 0.5, rng.random(3000).round(3))})
    small = pd.DataFrame({"g": rng.choice(["a", "b", None], 300), "v": rng.random(300).round(2)})
    pdf = pd.concat([big, small], ignore_index=True)
    pdf["id"] = range(len(pdf))
    pdf["y"] = (rng.random(len(pdf)) < pdf["v"] * 0.3).astype(int)
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, v double, id long, y int")


@pytest.mark.parametrize("blocks", [16, 64])
def test_ranks_match_pandas(skewed, blocks):
    pdf, df = skewed
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    ran = ordered.running_sums(counted, ["g"], "v", ["n"], blocks=blocks).toPandas()
    assert len(ran) == len(pdf.fillna({"g": "-"}).drop_duplicates(["g", "v"]))
    got = ordered.with_rank(df, ["g"], "v").toPandas().sort_values("id")
    want = pdf.fillna({"g": "-"}).groupby("g")["v"].rank()
    assert np.allclose(got["avg_rank"], want)


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = ordered.quantiles(df, ["g"], "v", {"q05": 0.05, "q50": 0.5, "q99": 0.99, "q100": 1.0}).toPandas()
    for row in got.itertuples():
        v = pdf[pdf["g"].isna()]["v"] if row.g is None else pdf[pdf["g"] == row.g]["v"]
        assert np.allclose([row.q05, row.q50, row.q99, row.q100], np.quantile(v, [0.05, 0.5, 0.99, 1.0]))


def test_row_numbers_are_a_permutation(skewed):
    pdf, df = skewed
    got = ordered.row_numbers(df, ["g"], "id").toPandas().fillna({"g": "-"})
    for _, part in got.groupby("g"):
        assert sorted(part["rn"]) == list(range(1, len(part) + 1))
        assert part.sort_values("id")["rn"].is_monotonic_increasing


def test_descending_row_numbers(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "v long")
    got = {r.v: r.rn for r in ordered.row_numbers(df, [], "v", descending=True).collect()}
    assert got[99] == 1 and got[0] == 100


def test_first_by_takes_the_least(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    got = {r.k: r.v for r in ordered.first_by(df, ["k"], [F.col("o")], ["v"]).collect()}
    assert got == {"a": "y", "b": "z"}


def brute_ap(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ends = np.r_[np.nonzero(np.diff(s))[0], len(s) - 1]
    tp, n = np.cumsum(y)[ends], ends + 1
    return float((np.diff(np.r_[0, tp]) * tp / n).sum() / y.sum())


def brute_auroc(y, s):
    r = pd.Series(s).rank().to_numpy()
    p = y.sum()
    return float((r[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p)))


def test_ap_and_auroc_by_group(skewed):
    pdf, df = skewed
    got = metrics.ranking_metrics(df, ["g"], "v", "y").toPandas()
    for row in got.itertuples():
        part = pdf[pdf["g"].isna()] if row.g is None else pdf[pdf["g"] == row.g]
        y, s = part["y"].to_numpy(), part["v"].to_numpy()
        assert row.n == len(part) and row.n_pos == y.sum()
        assert row.auprc == pytest.approx(brute_ap(y, s))
        assert row.auroc == pytest.approx(brute_auroc(y, s))


def test_average_precision_is_stepwise(spark):
    rows = list(zip([1, 0, 1, 0, 0, 1], [0.9, 0.8, 0.7, 0.6, 0.5, 0.5], strict=True))
    m = metrics.ranking_metrics(spark.createDataFrame(rows, "y int, s double"), [], "s", "y").first()
    assert m.auprc == pytest.approx(0.7222, abs=1e-4)
    assert m.auroc == pytest.approx(0.6111, abs=1e-4)


def test_one_class_has_no_ranking(spark):
    m = metrics.ranking_metrics(spark.createDataFrame([(1, 0.1), (1, 0.9)], "y int, s double"), [], "s", "y").first()
    assert m.auroc is None and m.auprc is None


def test_threshold_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    m = metrics.threshold_metrics(df, [], "s", "y").first()
    assert (m.accuracy, m.recall, m.precision, m.f1) == (1, 1, 1, 1)
    high = metrics.threshold_metrics(df, [], "s", "y", 0.95).first()
    assert high.recall == 0 and high.precision == 0 and high.f1 == 0


def test_regression_metrics(spark):
    same = spark.createDataFrame([(float(i), float(i)) for i in range(1, 5)], "t double, p double")
    m = metrics.regression_metrics(same, [], "t", "p").first()
    assert m.pearson_r == pytest.approx(1) and m.rmse == 0 and m.spearman_rho == pytest.approx(1)
    flat = spark.createDataFrame([(1.0, 0.5), (1.0, 1.5)], "t double, p double")
    m = metrics.regression_metrics(flat, [], "t", "p").first()
    assert m.r2 is None and m.pearson_r is None and m.mae == pytest.approx(0.5)


def test_effect_size_p_value(spark):
    df = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "v double, y int")
    m = metrics.effect_size(df, [], "v", "y").first()
    assert m.auroc == 1 and m.mean_hit == 14.5 and m.p_value < 0.001


def test_small_p_values_keep_their_digits(spark):
    import math

    from screenlab.operators.metrics import normal_two_sided

    zs = [0.0, 1e-9, 0.5, 1.97, 1.98, 2.0, 5.0, 10.0, 37.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal_two_sided(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / 2**0.5), rel=1e-11)
