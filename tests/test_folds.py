"""Fold roles, vocabularies and greedy group folds, and resampling by name, on small fixtures."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from screenlab.operators import folds, models, neighbours, pipeline, resample


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = [(k, "ABCDEFG"[min(6, int(rng.exponential(2)))], int(rng.random() < 0.3)) for k in range(300)]
    out += [(900, None, 1), (901, "", 0)]
    return spark.createDataFrame(out, "id long, grp string, label int").repartition(4).cache()


def test_every_row_has_one_role_in_every_fold(rows):
    table = folds.group_folds(rows, "grp", 30)
    names = sorted(r.fold for r in table.collect())
    got = folds.fold_roles(rows, "grp", table).collect()
    assert len(got) == 302 * len(names)
    following = dict(zip(names, names[1:] + names[:1], strict=True))
    for r in got:
        want = "validation" if r.grp == r.fold else "early_stop" if r.grp == following[r.fold] else "train"
        assert r.role == want


def test_vocabulary_of_a_fold_is_that_of_its_training_rows(spark, rows):
    rng = np.random.default_rng(3)
    seen = {(g, f"k{rng.integers(40)}") for g in [*"ABCDEFG", None] for _ in range(9)}
    table = folds.group_folds(rows, "grp", 30)
    pairs = {r.fold: r.next_fold for r in table.collect()}
    got = folds.fold_vocabulary(spark.createDataFrame(sorted(seen, key=str), "grp string, kmer string"), "grp", table)
    want = {(f, k) for f, e in pairs.items() for g, k in seen if g not in (f, e)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_groups_go_where_they_even_the_classes(rows):
    sizes = {}
    for r in rows.collect():
        pos, n = sizes.get(r.grp, (0, 0))
        sizes[r.grp] = (pos + r.label, n + 1)
    total = np.array([[p, n - p] for p, n in sizes.values()]).sum(0)
    held, want = np.zeros((3, 2)), {}
    for g, (p, n) in sorted(sizes.items(), key=lambda x: (-abs(x[1][1] - 2 * x[1][0]), x[0] is not None, x[0] or "")):
        options = []
        for i in range(3):
            after = held.copy()
            after[i] += (p, n - p)
            options.append((round((after / total).std(0).mean(), 9), held[i].sum(), i))
        want[g] = min(options)[2]
        held[want[g]] += (p, n - p)
    got = folds.stratified_group_folds(rows, "grp", "label", 3)
    assert {r.grp: r.fold for r in got.collect()} == want


def _design(spark, n=120, share=0.2):
    rng = np.random.default_rng(6)
    data = []
    for k in range(n):
        y = int(rng.random() < share)
        data.append((k, "AB"[k % 2], y, (rng.normal(size=3) + 1.2 * y).round(3).tolist()))
    df = spark.createDataFrame(data, "target long, cell string, label int, x array<double>")
    return df.withColumn("features", array_to_vector("x")).drop("x").withColumn("weight", F.lit(1.0)).cache()


@pytest.mark.parametrize("ratio", [0.5, 1.0])
def test_synthetic_rows_lie_between_two_near_positives(spark, ratio):
    df = _design(spark)
    points = df.select(F.col("target").alias("id"), vector_to_array("features").alias("vec"), F.col("label").alias("y"))
    at = {r.id: np.array(r.vec) for r in points.where("y = 1").collect()}
    made = neighbours.synthetic(points, k=4, ratio=ratio).collect()
    assert len(made) == int(ratio * (120 - len(at))) - len(at)
    counts = np.unique([r.id for r in made], return_counts=True)[1]
    assert counts.max() - (counts.min() if len(counts) == len(at) else 0) <= 1
    for r in made:
        a, b = at[r.id], at[r.neighbour]
        assert 0 <= r.t < 1 and np.allclose(r.vec, a + (b - a) * r.t)
        near = sorted(at, key=lambda k: (np.linalg.norm(at[k] - a).round(9), k))[1:5]
        assert r.neighbour in near


def test_resampling_by_name(spark):
    df = _design(spark)
    even = resample.resample(df, "smote", "label", "target").cache()
    assert {r.label: r.n for r in even.groupBy("label").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(
        (0, 1), df.where("label = 0").count()
    )
    assert even.columns == df.columns
    clean = resample.resample(df, "smote_tomek", "label", "target")
    left = {tuple(r.features.toArray().round(9)) for r in clean.collect()}
    keyed = [(k, r.features.toArray(), r.label) for k, r in enumerate(even.collect())]

    def nearest(k, v):
        return min((np.linalg.norm(v - w).round(9), j) for j, w, _ in keyed if j != k)[1]

    linked = {k for k, v, y in keyed if keyed[nearest(k, v)][2] != y and nearest(*keyed[nearest(k, v)][:2]) == k}
    assert left == {tuple(v.round(9)) for k, v, _ in keyed if k not in linked}
    few = resample.resample(df.where("label = 0"), "smote", "label", "target")
    assert few.count() == df.where("label = 0").count()


def test_a_run_balances_the_training_part_of_each_fold(spark, monkeypatch):
    df = _design(spark).withColumn("chrom", F.lit("1"))
    seen = []
    whole = models.balanced_rows

    def watched(rows, *rest, **named):
        seen.append({r.cell for r in rows.select("cell").distinct().collect()})
        return whole(rows, *rest, **named)

    monkeypatch.setattr(models, "balanced_rows", watched)
    config = pipeline.Config("decision_tree", cv="cellline", tuning="grid", space={"maxDepth": [1, 2]}, resampling="smote")
    done = pipeline.run(config, df, df)
    assert sorted(map(sorted, seen)) == [["A"], ["A", "B"], ["B"]]
    assert done.predictions.count() == 120
