"""Features fitted on training rows, saved models, and runs from sequences."""

import random

import numpy as np
import pytest

from screenlab.operators import gene_runs, models, pipeline


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    bodies = [(t, "".join(rng.choice("ACGT" if t % 2 else "AACG") for _ in range(60))) for t in range(60)]
    bodies[7] = (7, "TTTTTTTTTTTTTTTTTTTT")
    rows = [(t, c, str(t % 3), t % 2, float(t) if t % 5 else None) for t in range(60) for c in "xy"]
    rows = spark.createDataFrame(rows, "target long, cell string, chrom string, label int, distance double")
    return rows.cache(), spark.createDataFrame(bodies, "target long, seq string").cache(), dict(bodies)


def test_vocabulary_and_values_are_those_of_the_training_bodies(data):
    rows, bodies, text = data
    train = rows.where("target % 2 = 0")
    own = gene_runs.GeneFeatures.fit(train, bodies, 2, "xy")
    seen = {text[t][i : i + 2] for t in range(0, 60, 2) for i in range(59)}
    assert own.vocabulary == tuple(sorted(seen)) and "TT" not in seen
    at = {c: k for k, c in enumerate(own.columns)}
    for r in own.design(rows, bodies).collect():
        pairs = [text[r.target][i : i + 2] for i in range(len(text[r.target]) - 1)]
        known = [p for p in pairs if p in seen]
        for p in seen:
            assert np.isclose(r.features[at[f"body_{p}"]], known.count(p) / len(known) if known else 0.0)
        assert r.features[at[f"cell_{r.cell}"]] == 1
        assert r.features[at["distance"]] == (-1 if r.distance is None else r.distance)


def test_a_saved_model_scores_as_before_and_checks_what_it_gets(spark, data, tmp_path):
    rows, bodies, text = data
    own = gene_runs.GeneFeatures.fit(rows, bodies, 2, "xy")
    design = models.weighted(own.design(rows, bodies))
    model = models.build("histogram_trees", rounds=3, rate=0.5).fit(design)
    gene_runs.SavedModel(own, model).save(spark, str(tmp_path / "m"))
    read = gene_runs.SavedModel.load(spark, str(tmp_path / "m"))
    before = {(r.target, r.cell): r.score for r in models.predicted(model, design, gene_runs.KEYS).collect()}
    after = {(r.target, r.cell): r.score for r in read.score(rows, bodies).collect()}
    assert before == after and len(before) == 120
    one = {r.cell: r.score for r in read.score_one(spark, text[11].lower(), "xy", 11).collect()}
    assert one == {c: before[11, c] for c in "xy"}
    with pytest.raises(ValueError, match="unknown to the model"):
        read.score_one(spark, "ACGT", ["z"])
    short = gene_runs.GeneFeatures(2, own.cells, own.vocabulary[1:])
    gene_runs.SavedModel(short, model).save(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="columns"):
        gene_runs.SavedModel.load(spark, str(tmp_path / "bad"))


def test_a_run_fits_features_in_each_fold(data, monkeypatch):
    rows, bodies, _ = data
    seen = []
    whole = gene_runs.GeneFeatures.fit.__func__

    def watched(cls, train, *rest):
        seen.append({(r.target, r.cell) for r in train.select("target", "cell").collect()})
        return whole(cls, train, *rest)

    monkeypatch.setattr(gene_runs.GeneFeatures, "fit", classmethod(watched))
    config = pipeline.Config("decision_tree", cv="cellline", params={"maxDepth": 2}, class_weight="balanced")
    done = gene_runs.run_from_sequences(config, rows.where("target < 50"), rows.where("target >= 50"), bodies, 2, "xy")
    assert [{c for _, c in s} for s in seen] in ([{"x"}, {"y"}, {"x", "y"}], [{"y"}, {"x"}, {"x", "y"}])
    assert all(t < 50 for s in seen for t, _ in s)
    assert done.predictions.count() == 20 and done.cv.first().folds == 2
    assert {r.cell for r in done.metrics.collect()} == {None, "x", "y"}


def test_texts_are_counted_once_for_all_folds(data, monkeypatch):
    rows, bodies, _ = data
    calls, count = [], gene_runs.kmers.kmer_counts
    monkeypatch.setattr(gene_runs.kmers, "kmer_counts", lambda *a, **k: calls.append(a) or count(*a, **k))
    config = pipeline.Config("decision_tree", cv="cellline", params={"maxDepth": 2})
    gene_runs.run_from_sequences(config, rows.where("target < 50"), rows.where("target >= 50"), bodies, 2, "xy")
    assert len(calls) == 1
