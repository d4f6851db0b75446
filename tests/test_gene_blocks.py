"""Sums of gene-level blocks against their entries."""

from screenlab.operators import features


def test_block_sums_are_those_of_the_entries(spark):
    rows = [(t, c, d) for t, d in ((1, 12), (2, None), (3, 7), (9, 30)) for c in ("x", "y", "z")][:-1]
    df = spark.createDataFrame([*rows, (1, "x", 12)], "target int, cell string, distance int")
    bodies = spark.createDataFrame([(1, "ACGTAC"), (2, "AAAN"), (3, "N"), (5, "GGG")], "target int, seq string")
    coords = spark.createDataFrame([("x", [0.5, 0.0]), ("z", [-2.0, 1.5])], "cell string, vec array<double>")
    want = {}
    for r in features.gene_features(df, bodies, 2, ("x", "y"), coords).collect():
        want.setdefault((r.block, r.feature), []).append(r.value)
    out = features.gene_block_sums(df, bodies, 2, ("x", "y"), coords)
    got = {(r.block, r.feature): (r.n, round(r.total, 9), r.top) for r in out.collect()}
    assert got == {k: (len(v), round(sum(v), 9), max(v)) for k, v in want.items()}
    assert features.gene_block_sums(df.limit(0), bodies, 2, ("x", "y"), coords).count() == 0
