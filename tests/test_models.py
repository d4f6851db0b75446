"""Neighbours, registry, search and the configured run."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from screenlab.operators import models, neighbours, pipeline, sweep


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, a third of all rows being copies of one vector."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 5, (6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.3, (300, 8))
    x[:100] = x[0]
    rows = [(i, v.tolist(), int(i % 10 == 0)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, vec array<double>, y int").cache()


@pytest.mark.parametrize("pivots, piece", [(1, 1000), (8, 1000), (16, 25)])
def test_knn_is_exact(points, pivots, piece):
    x, df = points
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    want = {}
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)
        want[i] = [j for _, j in order[:7]]
    got = {}
    for r in neighbours.knn(df, df, 7, pivots=pivots, piece=piece).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == want


def test_penalties_equal_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, [1.0, 5.0, 0.2], (80, 3))
    y = x @ [1.0, -0.5, 2.0] + rng.normal(0, 0.5, 80) + 3
    rows = [(i, Vectors.dense(v), float(t), 1.0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["id", "features", "label", "weight"])
    got = models.fit_predict("ridge", df, df, ["id"], alpha=7.0).orderBy("id").toPandas()["score"].to_numpy()
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 7.0 * np.eye(3), c.T @ (y - y.mean()))
    assert np.abs(got - (c @ w + y.mean())).max() < 1e-4


def test_logistic_penalty_is_that_of_the_summed_loss(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (120, 2))
    y = (x[:, 0] + rng.normal(0, 1, 120) > 0).astype(float)
    weight = np.where(y == 1, 3.0, 1.0)
    rows = [(i, Vectors.dense(v), t, k) for i, (v, t, k) in enumerate(zip(x, y.tolist(), weight.tolist()))]
    df = spark.createDataFrame(rows, ["id", "features", "label", "weight"])
    got = models.fit_predict("logreg", df, df, ["id"], C=0.05).orderBy("id").toPandas()["score"].to_numpy()
    z = np.c_[(x - x.mean(0)) / x.std(0, ddof=1), np.ones(120)]
    a = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ a))
        g = 0.05 * z.T @ (weight * (p - y)) + a * [1, 1, 0]
        h = 0.05 * (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1.0, 1, 0])
        a -= np.linalg.solve(h, g)
    assert np.abs(got - 1 / (1 + np.exp(-z @ a))).max() < 1e-3


def test_smote_evens_the_classes(points):
    _, df = points
    out = neighbours.smote(df, 3)
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {0: 270, 1: 270}


def test_tomek_links(spark):
    rows = [(1, [0.0], 0), (2, [0.1], 1), (3, [5.0], 1), (4, [5.1], 1), (5, [9.0], 0)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, y int")
    assert {r.id for r in neighbours.tomek_links(df).collect()} == {1, 2}
    assert neighbours.without_tomek_links(df).count() == 3


def test_exact_matches_take_the_vote(spark):
    near = spark.createDataFrame([(1, 2, 0.0), (1, 3, 1.0), (4, 2, 1.0), (4, 3, 3.0)], "id long, neighbour long, distance double")
    labels = spark.createDataFrame([(2, 1), (3, 0)], "id long, y int")
    got = {r.id: r.probability for r in neighbours.knn_vote(near, labels).collect()}
    assert got == {1: 1.0, 4: pytest.approx(0.75)}


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.2)
        v = rng.normal(0, 1, 3) + np.array([2.0 * y, -1.0 * y, 0.0])
        rows.append((f"t{i}", "abc"[i % 3], str(i % 2), y, Vectors.dense(v)))
    df = spark.createDataFrame(rows, ["target", "cell", "chrom", "label", "features"])
    return df.withColumn("label", F.col("label").cast("int")).cache()


@pytest.mark.parametrize("name", ["logreg", "boosted_trees", "random_forest", "decision_tree", "linear_svm", "gaussian_nb"])
def test_classifiers_learn(design, name):
    params = {"maxIter": 5} if name in ("logreg", "boosted_trees", "linear_svm") else {}
    rows = models.weighted(design)
    out = models.fit_predict(name, rows, rows, ["label"], **params)
    m = models.ranking_metrics(out, [], "score", "label").first()
    assert m.auroc > 0.85
    assert out.where("score < 0 OR score > 1").isEmpty()


def test_kernel_features_learn(design):
    rows = models.weighted(design)
    out = models.kernel_svm(rows, rows, ["label"], 40, maxIter=10)
    assert models.ranking_metrics(out, [], "score", "label").first().auroc > 0.85


def test_bagging(design):
    rows = design.withColumn("k", F.xxhash64("target")).withColumn("weight", F.lit(1.0))
    out = models.balanced_bagging(rows, rows, "k", ["target", "label"], estimators=2)
    assert out.count() == 600
    assert models.ranking_metrics(out, [], "score", "label").first().auroc > 0.8


def test_registry_errors():
    with pytest.raises(KeyError, match="unknown model"):
        models.build("nothing")
    with pytest.raises(ValueError, match="already"):
        models.register("logreg")(lambda: None)


def test_draws_are_seeded_and_in_range():
    space = {"a": ("int", 2, 5), "b": ("float", 0.001, 1.0, "log"), "c": ("cat", ["x", "y"])}
    first, again = models.draws(space, 20, 3), models.draws(space, 20, 3)
    assert first == again and all(2 <= t["a"] <= 5 and 0.001 <= t["b"] <= 1 and t["c"] in "xy" for t in first)
    assert models.grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_base_rate(design):
    out = models.base_rate_model(design, design, ["target"])
    assert out.select("score").distinct().count() == 1


@pytest.mark.parametrize(
    "change, text",
    [
        ({"model": "no"}, "unknown model"),
        ({"cv": "rows"}, "cv must be"),
        ({"tuning": "grid", "space": {"maxDepth": [2]}}, "needs cross-validation"),
        ({"tuning": "grid", "cv": "cellline"}, "needs a search space"),
    ],
)
def test_configuration_is_checked(change, text):
    with pytest.raises(ValueError, match=text):
        pipeline.validate(pipeline.Config(**{"model": "decision_tree", **change}))


def test_configured_run(design):
    train, test = design.where("cell != 'c'"), design.where("cell = 'c'")
    config = pipeline.Config(model="decision_tree", cv="cellline", tuning="grid", space={"maxDepth": [1, 3]})
    run = pipeline.run(config, train, test)
    assert run.params["maxDepth"] in (1, 3) and run.cv.count() == 2
    overall = run.metrics.where("split = 'overall'").first()
    assert overall.n == 200 and overall.auroc > 0.8


def test_unlabelled_rows_are_predicted_not_scored(design):
    test = design.where("cell = 'c'").withColumn("label", F.lit(-1))
    run = pipeline.run(pipeline.Config(model="decision_tree"), design.where("cell != 'c'"), test)
    assert run.metrics is None and run.predictions.count() == 200 and "label" not in run.predictions.columns


def test_double_prediction_is_an_error(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="more than once"):
        models.require_once(df, ["k"])


def test_sweep_is_one_long_table(spark):
    def score(config, fold, seed):
        return spark.createDataFrame([(len(config) + seed / 10,)], "value double")

    results = sweep.run_sweep(["a", "bb"], ["f", "g"], [0, 1], score)
    assert results.count() == 8
    summary = {r.config: r for r in sweep.config_summary(results, "a").collect()}
    assert summary["bb"].delta == pytest.approx(1.0) and not summary["bb"].noise
    paired = sweep.paired_comparison(results, "a").first()
    assert (paired.wins, paired.pairs, paired.sign_consistent) == (4, 4, True)


def test_metric_by_name(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, s double")
    assert models.metric_by_name(df, "auroc", [], "s", "y").first().value == 1.0
    with pytest.raises(KeyError, match="unknown metric"):
        models.metric_by_name(df, "accuracy_squared", [], "s", "y")


def test_saved_run(spark, design, tmp_path):
    done = pipeline.run(pipeline.Config(model="decision_tree"), design, design.where("cell = 'c'"))
    pipeline.save(done, str(tmp_path / "runs"), "one")
    back = spark.read.parquet(str(tmp_path / "runs" / "predictions"))
    assert back.count() == 200 and back.first().run_id == "one"


def test_nested_search_uses_every_cell(spark, sf, monkeypatch):
    from screenlab.plans import roles, training

    grown, drawn = [], []
    grow, search = training.tree_search.grow, training.tree_search.nested_search

    def watched_grow(rows, fits, *rest):
        grown.append(fits)
        return grow(rows, fits, *rest)

    def watched_search(design, outer, fold, folds, trials, keep):
        drawn.extend(trials)
        return search(design, outer, fold, folds, trials, keep)

    monkeypatch.setattr(training.tree_search, "grow", watched_grow)
    monkeypatch.setattr(training.tree_search, "nested_search", watched_search)
    got = training.nested_random_search(spark, sf).collect()
    inner, final = grown
    assert len(drawn) == 50
    pairs = {(o, i) for o in roles.CELLS for i in roles.CELLS if i != o}
    assert {(f.outer, f.inner, f.least) for f in inner} == {(*x, t["minInstancesPerNode"]) for x in pairs for t in drawn}
    assert [(f.outer, f.inner) for f in final] == [(o, None) for o in roles.CELLS]
    assert {r["cell"] for r in got} == set(roles.CELLS)


def test_small_cells_share_a_bundle():
    points = np.array([[0.0], [10.0], [1.0], [11.0], [2.0], [12.0]])
    bundle = neighbours._bundles(points, np.array([4, 4, 4, 4, 4, 4]), 12)
    assert bundle[[0, 2, 4]].tolist() == [0, 0, 0] and bundle[[1, 3, 5]].tolist() == [1, 1, 1]
    assert neighbours._bundles(points, np.array([90, 1, 1, 1, 1, 1]), 12).max() == 1


def test_neighbours_among_many_copies(spark):
    """More copies than k: the smallest ids are the neighbours, whatever piece they are in."""
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 5.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in neighbours.knn(df, df, 3, pivots=4, piece=50).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert all(got[i] == [j for j in range(4) if j != i][:3] for i in range(300))
    assert len(got) == 320 and all(len(x) == 3 for x in got.values())


def test_neighbours_shuffle_no_vector_per_block(spark):
    """Four times the rows move four times the bytes, not sixteen times, however many blocks there are."""
    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        seen = context.statusStore().executorList(False)
        return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))

    rng, moved = np.random.default_rng(5), []
    for n in (1000, 4000):
        rows = [(i, v) for i, v in enumerate(rng.normal(size=(n, 32)).tolist())]
        df = spark.createDataFrame(rows, "id long, vec array<double>")
        before = written()
        assert neighbours.knn(df, df, 1, piece=50).count() == n
        moved.append(written() - before)
    assert moved[1] < 6 * moved[0], moved
