import random

import numpy as np

from screenlab.llm import additive
from screenlab.llm.op06 import query
from screenlab.llm.quality import FEATURES, fit_quality, keep_good, measured, score_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = query(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    right = {q: np.mean([r["predicted"] == q for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert right[0] > 0.9 and right[1] > 0.98


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1"
    turned = labels.selectExpr("doc_id", f"CASE WHEN {held} THEN 1 - quality ELSE quality END AS quality")
    a, b = fit_quality(docs, labels), fit_quality(docs, turned)
    assert a.base == b.base and all(map(np.array_equal, a.tables, b.tables))


def test_pairs_explain_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = additive.fit(x, y)
    assert (0, 2) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_one_kind_or_no_labels():
    x = np.random.default_rng(0).random((5, 2))
    assert additive.fit(x, np.ones(5)).score(x).min() > 0.8
    assert additive.fit(np.zeros((0, 2)), np.zeros(0)).score(x).tolist() == [0.5] * 5


def test_odd_documents(spark, odd, none):
    rng = random.Random(0)
    docs = [(k, " ".join(rng.choice(["good", "fine", "text."]) + str(k % 7) for _ in range(30))) for k in range(60)]
    docs += [(100 + k, " ".join(f"bad***{j}" for j in range(30))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs] + [(1, None), (None, 0)], "doc_id long, quality int")
    model = fit_quality(df, labels)
    assert score_quality(odd, model).filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert keep_good(df, labels).count() == 60
    assert keep_good(odd, labels).columns == odd.columns
    assert keep_good(none, labels).count() == 0
    assert measured(None) == measured(" \n") == [0.0] * len(FEATURES)
