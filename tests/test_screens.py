"""Labels, priors, leakage, folds, resampling and weights."""

import pytest
from pyspark.sql import functions as F

from screenlab.operators import folds, resample, screen

CELLS = ("HAP1", "K562", "MDA-MB-231", "THP1")


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = [
        (f"T{t}", c, 0.01 * (i + 1), -float(t + i + 1), int((t + i) % 2 == 0), "1")
        for t in range(2)
        for i, c in enumerate(CELLS)
    ]
    return spark.createDataFrame(rows, "target string, cell string, p double, fc double, label int, chrom string").cache()


def altered(df, cell):
    held = F.col("cell") == cell
    return df.withColumns(
        {
            "p": F.when(held, 0.9).otherwise(F.col("p")),
            "fc": F.when(held, 50.0).otherwise(F.col("fc")),
            "label": F.when(held, 1 - F.col("label")).otherwise(F.col("label")),
        }
    )


@pytest.mark.parametrize("p, fc, label", [(0.02, -0.9, 1), (0.8, -0.4, 0), (0.01, 0.8, 0)])
def test_hit_label(spark, p, fc, label):
    df = spark.createDataFrame([(p, fc)], "p double, fc double")
    assert df.select(screen.hit().alias("y")).first().y == label


@pytest.mark.parametrize("cell", CELLS)
def test_held_out_outcomes_reach_no_feature(outcomes, cell):
    for build in (
        lambda df: screen.cross_cell_priors(df, cell),
        lambda df: screen.source_pivot(df, CELLS, cell),
        lambda df: screen.gene_scores(df.where(F.col("cell") != cell)),
    ):
        before, after = build(outcomes), build(altered(outcomes, cell))
        assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_a_change_elsewhere_does_move_features(outcomes):
    before = screen.cross_cell_priors(outcomes, "THP1")
    after = screen.cross_cell_priors(altered(outcomes, "HAP1"), "THP1")
    assert not before.exceptAll(after).isEmpty()


def test_leave_one_out_by_hand(outcomes):
    row = (
        screen.leave_one_out(outcomes, "target", "cell", ["fc"])
        .where("target = 'T0' AND cell = 'K562'")
        .first()
    )
    others = [-1.0, -3.0, -4.0]
    mean = sum(others) / 3
    assert row.sources == 3 and row.fc_mean == pytest.approx(mean)
    assert (row.fc_max, row.fc_min) == (-1.0, -4.0)
    assert row.fc_std == pytest.approx((sum((x - mean) ** 2 for x in others) / 3) ** 0.5)


def test_a_single_source_has_no_spread(spark):
    df = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 2.0), ("u", "a", 5.0)], "target string, cell string, fc double")
    got = {(r.target, r.cell): r for r in screen.leave_one_out(df, "target", "cell", ["fc"]).collect()}
    assert got["t", "a"].fc_mean == 2.0 and got["t", "a"].fc_std == 0.0
    assert got["u", "a"].sources == 0 and got["u", "a"].fc_mean is None and got["u", "a"].fc_max is None


def test_guide_outcomes_without_finite_pairs_are_zero(spark):
    rows = [("c", "t", -1.0, -2.0), ("c", "t", -3.0, -1.0), ("c", "u", None, 1.0), ("c", "u", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "cell string, target string, rep1 double, rep2 double")
    got = {r.target: r for r in screen.guide_outcomes(df).collect()}
    assert got["t"].depletion_mean == pytest.approx(1.75) and got["t"].depletion_median == pytest.approx(1.5)
    assert got["t"].replicate_correlation == pytest.approx(-1.0) and got["t"].guide_count == 2
    assert got["u"].guide_count == 0 and got["u"].depletion_mean == 0


def test_guards(outcomes):
    with pytest.raises(ValueError, match="derived from the answer"):
        screen.assert_no_columns(outcomes, ["fc"])
    with pytest.raises(ValueError, match="no rows left"):
        screen.keep_cells(outcomes, only=["nowhere"])
    with pytest.raises(ValueError, match="day"):
        screen.assert_none(outcomes.withColumn("day", F.lit(7)), F.col("day") != 14, "day must be 14")
    with pytest.raises(KeyError):
        screen.outcome_column("p")


def test_baseline_is_neutral_for_unseen_targets(spark, outcomes):
    keys = spark.createDataFrame([("T0", "x"), ("new", "x")], "target string, cell string")
    got = {r.target: r.y_pred_proba for r in screen.baseline_submission(outcomes, keys).collect()}
    assert got == {"T0": 2.5, "new": 0.0}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"{i % 4 + 1}" if i % 4 else "", int(i % 5 == 0)) for i in range(400)]
    return spark.createDataFrame(data, "k long, chrom string, label int").cache()


def test_small_and_missing_groups_are_no_folds(rows):
    assert folds.group_folds(rows, "chrom", 101).isEmpty()
    got = {r.fold: r.next_fold for r in folds.group_folds(rows, "chrom", 100).collect()}
    assert got == {"2": "3", "3": "4", "4": "2"}


def test_roles_cover_every_row(rows):
    roles = rows.select(folds.fold_role("chrom", "2", "3").alias("r")).groupBy("r").count().collect()
    assert {r.r: r["count"] for r in roles} == {"validation": 100, "early_stop": 100, "train": 200}


def test_natural_order(spark):
    df = spark.createDataFrame([(c,) for c in ("10", "2", "X", "1", "22")], "c string")
    assert [r.c for r in df.orderBy(*folds.natural("c")).collect()] == ["1", "2", "X", "10", "22"]


def test_stratified_folds_are_even(rows):
    got = folds.stratified_folds(rows, "label", "k", 4).groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    assert all(r.n == 100 and r.p == 20 for r in got) and len(got) == 4


def test_group_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(i % 23, int(i % 7 == 0)) for i in range(2300)], "g int, label int")
    got = folds.stratified_group_folds(df, "g", "label", 5).collect()
    assert len(got) == 23 and {r.fold for r in got} == set(range(5))
    sizes = [sum(r.n for r in got if r.fold == f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 100


def test_published_features_hold_no_answers(outcomes):
    parts = folds.publish_holdout(outcomes, "cell", "THP1", ["HAP1"])
    assert folds.leaked_columns(parts["features"]) == []
    assert {r.cell for r in parts["train"].select("cell").distinct().collect()} == {"K562", "MDA-MB-231"}
    assert parts["labels"].count() == parts["features"].count() == 2


def balance(df):
    return {r.label: r["count"] for r in df.groupBy("label").count().collect()}


def test_resampling(rows):
    under = resample.resample(rows, "random_under", "label", "k")
    over = resample.resample(rows, "random_over", "label", "k")
    assert balance(under) == {0: 80, 1: 80} and balance(over) == {0: 320, 1: 320}
    assert under.distinct().count() == 160 and over.distinct().count() == 400
    assert over.exceptAll(over.intersectAll(over)).isEmpty()
    assert balance(resample.resample(rows, "random_under", "label", "k", 0.5)) == {0: 160, 1: 80}
    with pytest.raises(ValueError, match="unknown resampling"):
        resample.resample(rows, "other", "label", "k")


def test_bagging_draws_without_replacement(rows):
    out = resample.bagging_samples(rows, "label", "k", 3, 2.0)
    for r in out.groupBy("estimator").agg(F.count("*").alias("n"), F.countDistinct("k").alias("d"), F.sum("label").alias("p")).collect():
        assert (r.n, r.d, r.p) == (240, 240, 80)


def test_weights_average_one(spark):
    cells = spark.createDataFrame(
        [("a", [0.0, 0.0], "x", 0.1), ("b", [3.0, 4.0], "x", 0.2), ("c", [6.0, 8.0], "y", 0.05)],
        "cell string, vec array<double>, lineage string, rate double",
    )
    for name, scheme in resample.SCHEMES.items():
        args = (3.0,) if name == "lineage" else ()
        got = {r.cell: r.weight for r in scheme(cells, "a", *args).collect()}
        assert set(got) == {"b", "c"} and sum(got.values()) == pytest.approx(2.0)
    near = {r.cell: r.weight for r in resample.distance_weights(cells, "a").collect()}
    assert near["b"] > near["c"]


def test_other_cells_statistics_are_plain_arithmetic(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, None)], "target int, cell string")
    known = spark.createDataFrame([(1, "x", 2.0), (1, "y", 6.0), (2, "x", -1.0)], "target int, cell string, m double")
    out = screen.guide_outcomes_across(rows, known, ["x", "y", "z"], ["m"])
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.target, r.cell): tuple(r)[2:] for r in out.collect()}
    assert got[1, "x"] == (0.0, 6.0, 0.0, 3.0, 6.0, 0.0, 3.0)
    assert got[1, "y"] == (2.0, 0.0, 0.0, 1.0, 2.0, 0.0, 1.0)
    assert got[2, "z"] == (-1.0, 0.0, 0.0, -0.5, 0.0, -1.0, 0.5)
    assert got[3, None][3:6] == (None, None, None)
