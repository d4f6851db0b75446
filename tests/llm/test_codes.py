import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.llm.codes import Codebooks, pivots_of, vector_codes


def plain(rows, parts, entries, rounds, scale=1024):
    """(id, code, error) and all entries by trying every entry, in Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(ints[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(c[p], books[p])[1]].append(c[p])
            for k, members in held.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for (i, _), c in zip(ints, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, [k for _, k in found], sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("n,width,entries,spread", [(300, 8, 16, 0.5), (120, 4, 256, 0.002), (200, 12, 7, 0.01)])
def test_equal_to_trying_every_entry(spark, n, width, entries, spread):
    rng = np.random.default_rng(n)
    rows = [(int(k), (rng.integers(-9, 9, width) * spread / 9).tolist()) for k in rng.permutation(n)]
    rows += rows[:20] + [(None, rows[3][1]), (5000, None), (5001, [0.1, None] * (width // 2)), (5002, [math.nan] * width)]
    rows += [(5003, [math.inf] * width), (-1, [0.0] * width), (-2, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("row", "ints", "away", "code", "error", "part", "label")})
    coded, books = vector_codes(df, parts=4, entries=entries, rounds=3)
    want, entries_of = plain(rows, 4, entries, 3)
    got = coded.select("row.vec_id", "code", "error").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert [b.tolist() for b in books.entries] == entries_of
    text = ",".join(str(x) for b in entries_of for e in b for x in e)
    assert books.digest() == hashlib.sha256(text.encode()).hexdigest()


def test_bounds_never_cut_the_nearest():
    rng = np.random.default_rng(4)
    for width, spread in [(16, 300), (16, 2), (4, 1), (1, 5), (16, 1 << 26)]:
        parts = rng.integers(-spread, spread + 1, (700, width))
        book = parts[:256].copy()
        book[100] = book[3]
        books = Codebooks([book])
        entry, error = books.assigned(parts[:, None], books.away(parts[:, None]))
        full = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (entry[:, 0] == full.argmin(1)).all() and (error[:, 0] == full.min(1)).all()
    assert len(pivots_of(np.zeros((9, 4), np.int64))) == 1


def test_no_usable_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [None, 1.0])], "vec_id long, embedding array<float>")
    for given in (df, df.limit(0)):
        coded, books = vector_codes(given)
        assert books is None and coded.count() == 0


def test_unequal_lengths_and_huge_components_are_errors(spark):
    for rows in ([(1, [0.1] * 8), (2, [0.1] * 4)], [(1, [0.1] * 6)], [(1, [1e9] * 8)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="length"):
            vector_codes(df)

