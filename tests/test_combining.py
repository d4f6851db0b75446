"""Ensembles, boards and bootstrap."""

import pytest
from pyspark.sql import functions as F

from screenlab.operators import board, bootstrap, ensemble

SCHEMA = "model string, key long, score double"


def preds(spark, **models):
    return spark.createDataFrame([(m, i, float(s)) for m, scores in models.items() for i, s in enumerate(scores)], SCHEMA)


def by_key(df):
    return [r.score for r in df.orderBy("key").collect()]


def test_rank_average_ignores_scale(spark):
    got = by_key(ensemble.rank_average(preds(spark, a=[1, 2, 3], b=[1000, 2000, 3000]), ["key"]))
    assert got == sorted(got) and len(set(got)) == 3


def test_opposite_models_tie(spark):
    assert len(set(by_key(ensemble.rank_average(preds(spark, a=[1, 2, 3], b=[3, 2, 1]), ["key"])))) == 1


def test_weights_tip_the_scale(spark):
    got = by_key(ensemble.rank_average(preds(spark, a=[1, 2, 3], b=[3, 2, 1]), ["key"], {"a": 3.0, "b": 1.0}))
    assert got == sorted(got)


def test_minmax_blend(spark):
    df = preds(spark, a=[10, 20], b=[4, 2])
    assert by_key(ensemble.minmax_blend(df, ["key"], {"a": 0.75, "b": 0.25})) == [0.25, 0.75]
    with pytest.raises(ValueError, match="sum to 1"):
        ensemble.minmax_blend(df, ["key"], {"a": 0.7, "b": 0.25})


def test_coverage_is_checked(spark):
    good = preds(spark, a=[1, 2], b=[1, 2])
    assert ensemble.require_coverage(good, ["key"], "model", 2) is good
    with pytest.raises(ValueError, match="cover"):
        ensemble.require_coverage(preds(spark, a=[1, 2], b=[1]), ["key"], "model", 2)
    with pytest.raises(ValueError, match="cover"):
        ensemble.require_coverage(good.unionByName(good.limit(1)), ["key"], "model", 2)


def test_constant_scores_have_zero_z(spark):
    got = ensemble.zscores(preds(spark, a=[5, 5, 5])).collect()
    assert all(r.z == 0 for r in got)


TRUTH = [(t, c, int(t == 1)) for t in range(4) for c in ("a", "b")]


def submissions(spark):
    truth = spark.createDataFrame(TRUTH, "target long, cell string, label int")
    perfect = [("good", t, c, str(float(y))) for t, c, y in TRUTH]
    bad = [("bad", t, c, "x" if t == 0 else "0.1") for t, c, _ in TRUTH[:-1]] + [("bad", 9, "a", "1"), ("bad", 1, "a", "1")]
    subs = spark.createDataFrame(perfect + bad, "submission string, target long, cell string, score string")
    return subs, truth


def test_problem_list(spark):
    subs, truth = submissions(spark)
    none = truth.where("false").select("target", "cell")
    got = {(r.submission, r.problem): r.n for r in board.problem_list(subs, truth, none, "submission", ["target", "cell"], "score").collect()}
    assert got == {("bad", "duplicate"): 1, ("bad", "missing"): 1, ("bad", "extra"): 1, ("bad", "not a finite number"): 2}
    excluded = spark.createDataFrame([(9, "a")], "target long, cell string")
    again = board.problem_list(subs, truth, excluded, "submission", ["target", "cell"], "score")
    assert again.where("problem = 'extra'").isEmpty()


def test_scores_come_from_the_truth(spark):
    subs, truth = submissions(spark)
    good = subs.where("submission = 'good'").withColumn("score", F.col("score").cast("double"))
    m = board.score_all(good, truth, "submission", ["target", "cell"], "score", "label").first()
    assert (m.auroc, m.auprc, m.lift) == (1.0, 1.0, 4.0)


def test_only_eligible_rows_are_placed(spark):
    df = spark.createDataFrame([("a", 0.2, True), ("b", 0.9, False), ("c", 0.5, True)], "submission string, auprc double, ok boolean")
    got = {r.submission: r.place for r in board.leaderboard(df, "submission", "ok").collect()}
    assert got == {"a": 2, "b": None, "c": 1}


@pytest.mark.parametrize(
    "meta, wrong",
    [
        ({"submitter": "a-b", "model": "m", "uses_measured_depletion": False}, 0),
        ({"submitter": "-ab", "model": "m", "uses_measured_depletion": False}, 1),
        ({"submitter": "a--b", "model": "m", "uses_measured_depletion": "no"}, 2),
        ({"model": "m"}, 2),
    ],
)
def test_metadata(meta, wrong):
    assert len(board.metadata_problems(meta)) == wrong


def test_bootstrap_brackets_the_estimate(spark):
    rows = [(i, float((i * 37) % 101) / 101 + 0.3 * (i % 9 == 0), int(i % 9 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    a = bootstrap.ap_interval(df, [], "s", "y", replicates=150).first()
    b = bootstrap.ap_interval(df, [], "s", "y", replicates=150).first()
    assert a.ci_low < a.auprc < a.ci_high and 0 < a.ci_width < 0.5
    assert (a.ci_low, a.ci_high) == (b.ci_low, b.ci_high)


def test_bootstrap_draws_do_not_follow_a_setting(spark):
    rows = [(float((i * 37) % 101), int(i % 9 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    ends = []
    for blocks in (3, 40):
        reps = bootstrap.ap_replicates(df, [], "s", "y", replicates=100, blocks=blocks)
        ends.append({r.replicate: round(r.ap, 12) for r in reps.collect()})
    assert len(ends[0]) == 100 and ends[0] == ends[1]


def test_bootstrap_counts_are_poisson():
    import numpy as np

    key = np.arange(20_000, dtype=np.uint64) * np.uint64(12345)
    for mean in (1, 3, 40):
        u = bootstrap._uniform(key, np.arange(5), 0, 1)
        x = bootstrap._poisson(np.full(len(key), mean), u)
        assert abs(x.mean() - mean) < 0.03 * mean and abs(x.var() - mean) < 0.05 * mean


def test_models_meet_their_summary_without_a_join(spark):
    rows = [("a", 1, 1.0), ("a", 2, 3.0), (None, 1, 5.0), (None, 2, 9.0), ("", 1, 2.0), ("", 2, 2.0)]
    df = spark.createDataFrame(rows, "model string, k int, score double")
    out = ensemble.zscores(df)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.model, r.k): r.z for r in out.collect()} == {
        ("a", 1): -1.0, ("a", 2): 1.0, (None, 1): -1.0, (None, 2): 1.0, ("", 1): 0.0, ("", 2): 0.0
    }


def test_coverage_deals_rows_out_once_in_more_parts(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b")]
    df = spark.createDataFrame(rows, "k int, model string")
    out = ensemble.coverage_problems(df, ["k"], "model", 2)
    assert sorted(map(tuple, out.collect())) == [(2, 1, 1), (3, 2, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(k" in plan and f", {parts})" in plan and "ENSURE_REQUIREMENTS" not in plan
