"""The approximate index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.operators import neighbours, vector_index


def _frame(spark, points, start=0):
    rows = [(start + k, v.tolist()) for k, v in enumerate(points)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(6)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12)) * 4
    points = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12)) * 0.5
    points[100:140] = points[100]  # one vector many times
    return _frame(spark, points).cache()


def test_clusters_are_found_in_few_cells(clustered):
    index = vector_index.fit_index(clustered, 10, cells=30)
    assert index.probes <= 12
    rows = vector_index.index_rows(index, clustered)
    assert rows.count() == 3000
    asked = clustered.where(F.col("id") % 20 == 0)
    # Small pieces give the same neighbours as large ones.
    found = [
        {(r.id, r.place): (r.neighbour, r.distance) for r in vector_index.search_index(
            index, rows, clustered, asked, 10, piece=piece).collect()}
        for piece in (50, 4096)
    ]
    exact = {(r.id, r.place): (r.neighbour, r.distance) for r in neighbours.knn(asked, clustered, 10).collect()}
    assert len(exact) == 1500
    for one in found:
        assert len(one) == 1500
        assert len(set((k[0], v[0]) for k, v in one.items()) & set((k[0], v[0]) for k, v in exact.items())) >= 0.9 * 1500
        truth = {(k[0], v[0]): v[1] for k, v in exact.items()}
        assert all(truth.get((k[0], v[0]), v[1]) == v[1] for k, v in one.items())


def test_keeping_all_rows_in_all_cells_is_exact(spark):
    rng = np.random.default_rng(4)
    df = _frame(spark, rng.normal(size=(200, 6)))
    index = vector_index.fit_index(df, 5, cells=4, recall=1.0)
    index = vector_index.VectorIndex(index.centres, index.entries, len(index.centres))
    found = vector_index.search_index(index, vector_index.index_rows(index, df), df, df, 5, keep=200)
    key = ["id", "place", "neighbour", "distance"]
    assert sorted(found.select(key).collect()) == sorted(neighbours.knn(df, df, 5).select(key).collect())


def test_recall_counts_what_is_missing(spark):
    exact = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 4)], "id long, neighbour long")
    found = spark.createDataFrame([(1, 2), (2, 4), (2, 9)], "id long, neighbour long")
    assert tuple(vector_index.recall(found, exact).first()) == (4, 0.5)


def test_tiny_and_empty_corpora(spark):
    df = _frame(spark, np.array([[0.0, 1.0], [0.0, 1.0], [3.0, 4.0]]))
    index = vector_index.fit_index(df, 2)
    found = vector_index.search_index(index, vector_index.index_rows(index, df), df, df, 2)
    assert {r.id: r.distance for r in found.where("place = 1").collect()}.keys() == {0, 1, 2}
    with pytest.raises(ValueError, match="empty"):
        vector_index.fit_index(df.limit(0))


def test_codes_tell_near_rows_of_data_without_structure(spark):
    """Of the 15 nearest, nearly all are among the 30 that the codes put first."""
    x = np.random.default_rng(5).normal(0, 1, (6000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    index = vector_index.fit_index(df, 15)
    cell = index.cells(x, 1)[:, 0]
    codes, asked = index.codes(x, cell), x[:100]
    rough = np.empty((len(asked), len(x)))
    for c in set(cell.tolist()):
        rough[:, cell == c] = index.rough(asked, c, codes[cell == c])
    true = ((asked[:, None] - x[None]) ** 2).sum(2)
    first = np.argsort(rough, 1)[:, :31]
    hit = [len(set(a) & set(b)) / 16 for a, b in zip(first.tolist(), np.argsort(true, 1)[:, :16].tolist())]
    assert np.mean(hit) >= 0.9
