"""Trees grown together against trees grown one by one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from screenlab.operators.tree_search import Fit, alike, average_precision, binned, grow, held_counts, nested_search


def plain_tree(x, y, edges, depth, least, positive=None):
    """Score of a row by a tree grown with plain loops."""
    if positive is None:
        positive = (y == 0).sum() / y.sum() if y.sum() else 1.0

    def impure(labels):
        a, b = (labels == 0).sum(), positive * (labels == 1).sum()
        return 2 * a * b / (a + b) if a + b else 0.0

    best = (0.0, None)
    for f in range(x.shape[1]) if depth else ():
        for e in edges[f]:
            left = x[:, f] <= e
            if min(left.sum(), (~left).sum()) >= least:
                gain = round(impure(y) - impure(y[left]) - impure(y[~left]), 9)
                if gain > best[0]:
                    best = (gain, f, e)
    if best[1] is None:
        a, b = (y == 0).sum(), positive * y.sum()
        return lambda row: b / (a + b) if a + b else 0.0
    _, f, e = best
    left = x[:, f] <= e
    low, high = (plain_tree(x[k], y[k], edges, depth - 1, least, positive) for k in (left, ~left))
    return lambda row: low(row) if row[f] <= e else high(row)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for o in "ABC":
        for k in range(180):
            c = "ABC"[k % 3]
            v = rng.normal(size=3).round(1)
            y = int(rng.random() < 1 / (1 + np.exp(2 - 2 * v[0] * (1 + (o == "B")))))
            rows.append((k, o, c, y, v.tolist()))
    df = spark.createDataFrame(rows, "id long, outer string, cell string, label int, x array<double>")
    return df.withColumn("features", array_to_vector("x")).repartition(4).cache(), rows


def test_trees_equal_those_grown_one_by_one(data):
    df, rows = data
    edges = {o: [[-1.0, -0.3, 0.0, 0.4, 1.1]] * 3 for o in "ABC"}
    kept = binned(df, "outer", "cell", edges, ["id"])
    fits = [Fit(o, i, m) for o in "ABC" for i in [*"ABC", None] if i != o for m in (1, 7, 20)]
    trees = grow(kept, fits, 3, 3, 6)
    every = np.array([r[4] for r in rows])
    codes = np.stack([np.searchsorted(edges["A"][k], every[:, k], "left") for k in range(3)], 1)
    for f in fits:
        mine = [r for r in rows if r[1] == f.outer and r[2] not in (f.outer, f.inner)]
        x, y = np.array([r[4] for r in mine]), np.array([r[3] for r in mine])
        at = trees[f].nodes(codes).tolist()
        for depth in (1, 2, 3):
            want = plain_tree(x, y, edges["A"], depth, f.least)
            share = trees[f].shares(depth)
            assert np.allclose([share[n][1] for n in at], [want(v) for v in every])


def test_search_takes_the_best_setting_of_the_inner_folds(data):
    df, rows = data
    trials = [{"maxDepth": d, "minInstancesPerNode": m} for d, m in ((1, 30), (3, 1), (2, 10), (3, 10))]
    out, best = nested_search(df, "outer", "cell", "ABC", trials, ["id", "label"], bins=8)
    got = {(r.outer, r.id): r.score for r in out.collect()}
    assert len(got) == 180 and {o for o, _ in got} == set("ABC")
    from screenlab.operators.boosting import bin_edges

    for o in "ABC":
        edges = bin_edges(df.where(f"outer = '{o}' AND cell <> '{o}'"), 3, 8)

        def of(cells, o=o):
            mine = [r for r in rows if r[1] == o and r[2] in cells]
            return np.array([r[4] for r in mine]), np.array([r[3] for r in mine])

        scores = []
        for t in trials:
            told = []
            for i in set("ABC") - {o}:
                tree = plain_tree(*of(set("ABC") - {o, i}), edges, t["maxDepth"], t["minInstancesPerNode"])
                x, y = of({i})
                told.append(average_precision([(tree(v), 1 - k, k) for v, k in zip(x, y.tolist(), strict=True)]))
            scores.append(np.mean(told))
        assert best[o][0] == trials[int(np.argmax(np.round(scores, 12)))]
        assert np.isclose(best[o][1], max(scores))
        tree = plain_tree(*of(set("ABC") - {o}), edges, best[o][0]["maxDepth"], best[o][0]["minInstancesPerNode"])
        for r in rows:
            if r[1] == o and r[2] == o:
                assert np.isclose(got[o, r[0]], tree(np.array(r[4])))


def test_trees_that_are_alike_are_walked_once(data):
    df, rows = data
    edges = {o: [[-1.0, -0.3, 0.0, 0.4, 1.1]] * 3 for o in "ABC"}
    kept = binned(df, "outer", "cell", edges, ["id"])
    fits = [Fit(o, i, m) for o in "ABC" for i in "ABC" if i != o for m in (1, 2, 20)]
    trees = grow(kept, fits, 2, 3, 6)
    same = alike(trees)
    assert sorted(f for g in same for f in g) == sorted(fits) and len(same) < len(fits)
    got = held_counts(kept, trees)
    for f in fits:
        want = {}
        for _, o, c, y, v in rows:
            if o == f.outer and c == f.inner:
                code = np.array([[np.searchsorted(edges[o][k], v[k], "left") for k in range(3)]])
                want.setdefault(int(trees[f].nodes(code)[0]), [0, 0])[y] += 1
        assert got[f] == {n: tuple(x) for n, x in want.items()}


def test_average_precision_by_hand():
    assert average_precision([(0.9, 0, 1), (0.5, 1, 1), (0.1, 2, 0)]) == pytest.approx((1 + 2 / 3) / 2)
    assert average_precision([(0.9, 0, 1)]) is None and average_precision([]) is None


def test_rows_are_packed_and_only_held_out_ones_keep_columns(data):
    df, rows = data
    edges = {o: [[-1.0, -0.3, 0.0, 0.4, 1.1]] * 3 for o in "ABC"}
    kept = binned(df, "outer", "cell", edges, ["id"]).collect()
    assert len(kept) <= 4 * 9 and all((r["id"] is None) == (r["_o"] != r["_f"]) for r in kept)
    assert sum(len(r["_b"]) for r in kept) == 3 * len(rows)
    assert sorted(i for r in kept for i in r["id"] or ()) == sorted(r[0] for r in rows if r[1] == r[2])
    for r in kept:
        if r["_o"] == r["_f"]:
            of = {x[0]: x for x in rows if x[1] == r["_o"]}
            want = np.array([np.searchsorted(edges["A"][0], of[i][4], "left") for i in r["id"]], np.uint8)
            assert bytes(r["_b"]) == want.T.tobytes() and list(r["_y"]) == [of[i][3] for i in r["id"]]


def test_designs_of_all_outer_cells_are_the_priors(spark, sf, monkeypatch):
    """Features made from one row a target equal those joined for each outer cell; only that row is stored."""
    from screenlab.operators import screen
    from screenlab.plans import roles
    from screenlab.plans.training import NAMES

    stored, written = [], screen.written
    monkeypatch.setattr(screen, "written", lambda df: stored.append(df) or written(df))
    gene = roles.gene(spark, sf).where("NOT (target % 7 = 3 AND cell IN ('AF', 'RO', 'NO'))")
    got = screen.cross_cell_designs(gene, roles.CELLS)
    assert len(stored) == 1 and stored[0].count() == gene.select("target").distinct().count()
    got = {(r.outer, r.target, r.cell): (r.label, r.features) for r in got.collect()}
    assert len(got) == 6 * gene.count()
    labels = {(r.target, r.cell): r.label for r in gene.collect()}
    for outer in ("AF", "RF"):
        for r in screen.cross_cell_priors(gene, outer).fillna(0.0, subset=NAMES).collect():
            label, features = got[outer, r.target, r.cell]
            assert label == labels[r.target, r.cell] and np.allclose(features, [r[n] for n in NAMES], 0, 1e-12)
