"""Boosting against a booster that goes through all rows and cuts one by one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from screenlab.operators import models
from screenlab.operators.boosting import LOSSES, Boosted, Settings, bin_edges, fit_boosted


def plain(x, y, w, watched, edges, s):
    """Margins of all rows after each tree."""
    loss = LOSSES[s.loss]
    fit = ~watched
    mean = (y[fit] * w[fit]).sum() / w[fit].sum()
    m = np.full(len(y), np.log(mean / (1 - mean)) if s.loss == "logistic" else mean)
    out, losses = [m.copy()], []

    def pulled(g):
        return np.sign(g) * max(abs(g) - s.threshold, 0)

    for _ in range(s.rounds):
        g, h, _ = loss(m, y)
        g, h = g * w, h * w

        def grow(rows, depth, g=g, h=h):
            use = rows & fit
            total = pulled(g[use].sum()) ** 2 / (h[use].sum() + s.penalty)
            best = (1e-9, None)
            for f in range(x.shape[1]) if depth < s.depth else ():
                for e in edges[f]:
                    left = x[:, f] <= e
                    a, b = use & left, use & ~left
                    if h[a].sum() < s.least or h[b].sum() < s.least:
                        continue
                    gain = sum(pulled(g[k].sum()) ** 2 / (h[k].sum() + s.penalty) for k in (a, b)) - total
                    if gain > best[0] * (1 + 1e-10):
                        best = (gain, left)
            if best[1] is None:
                m[rows] += -s.rate * pulled(g[use].sum()) / (h[use].sum() + s.penalty)
            else:
                grow(rows & best[1], depth + 1)
                grow(rows & ~best[1], depth + 1)

        losses.append((loss(m, y)[2] * w)[watched].sum() / w[watched].sum() if watched.any() else None)
        grow(np.ones(len(y), bool), 0)
        out.append(m.copy())
    return out, losses


def _data(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    y = x[:, 0] * 2 + (x[:, 1] > 0.3) * 3 + rng.standard_t(2, n)
    w = rng.integers(1, 4, n) * 0.5
    watched = rng.random(n) < 0.2
    rows = [(k, x[k].tolist(), float(y[k]), float(w[k]), bool(watched[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double, weight double, watch boolean")
    return df.withColumn("features", array_to_vector("x")).repartition(5).cache(), x, y, w, watched


@pytest.mark.parametrize("loss", sorted(LOSSES))
def test_equal_to_going_through_all_cuts(spark, loss):
    df, x, y, w, watched = _data(spark)
    if loss == "logistic":
        y = (y > 1).astype(float)
        df = df.withColumn("label", (F.col("label") > 1).cast("double"))
    s = Settings(loss, rounds=12, depth=2, rate=0.3, penalty=1.0, threshold=0.2, least=2.0)
    edges = bin_edges(df.where("NOT watch"), 4, 8)
    model = fit_boosted(df, s, ["id"], watch="watch", edges=edges)
    margins, losses = plain(x, y, w, watched, edges, s)
    assert len(model.trees) == 12
    assert np.allclose(model.margins(x), margins[-1], atol=1e-9)
    assert np.allclose(model.watched[:12], losses, atol=1e-9)
    got = {r.id: r.score for r in models.predicted(model, df, ["id"]).collect()}
    want = 1 / (1 + np.exp(-margins[-1])) if loss == "logistic" else margins[-1]
    assert np.allclose([got[k] for k in range(len(y))], want, atol=1e-9)
    again = Boosted.read(model.text())
    assert np.array_equal(again.margins(x), model.margins(x))


def test_stops_where_the_watched_loss_was_lowest(spark):
    df, x, y, w, watched = _data(spark, seed=5)
    s = Settings("pseudo_huber", rounds=40, depth=3, rate=0.5, penalty=1.0, least=0.5, patience=3)
    model = fit_boosted(df, s, ["id"], watch="watch", bins=16)
    _, losses = plain(x, y, w, watched, model.edges, Settings(**{**s.__dict__, "rounds": len(model.watched)}))
    assert 0 < len(model.trees) == int(np.argmin(losses)) < 40
    assert len(model.watched) == len(model.trees) + 4


def test_shares_of_rows_and_columns_change_trees_and_still_learn(spark):
    df, x, y, *_ = _data(spark, n=600, seed=7)
    whole = fit_boosted(df, Settings(rounds=10), ["id"], bins=16)
    part = fit_boosted(df, Settings(rounds=10, row_share=0.6, column_share=0.5, seed=3), ["id"], bins=16)
    again = fit_boosted(df.repartition(3), Settings(rounds=10, row_share=0.6, column_share=0.5, seed=3), ["id"], bins=16)
    assert all(len({f for f in t.feature.values()}) <= 2 for t in part.trees)
    assert np.allclose(part.margins(x), again.margins(x))
    spread = ((y - y.mean()) ** 2).mean()
    assert ((whole.margins(x) - y) ** 2).mean() < ((part.margins(x) - y) ** 2).mean() * 1.2 < spread


def test_constant_labels_and_no_rows(spark):
    df = spark.createDataFrame([(k, [float(k)], 2.0) for k in range(20)], "id long, x array<double>, label double")
    df = df.withColumn("features", array_to_vector("x"))
    model = fit_boosted(df, Settings(rounds=3), ["id"])
    assert np.allclose(model.margins(np.arange(20.0)[:, None]), 2.0)
    assert models.build("boosted_regression", rounds=2).fit(df).trees == model.trees[:2]
    with pytest.raises(ValueError, match="labels"):
        fit_boosted(df.withColumn("label", F.lit(1)), Settings("logistic", rounds=1))
