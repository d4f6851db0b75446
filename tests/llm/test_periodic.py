import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from screenlab.llm import periodic
from screenlab.llm.op11 import planted
from screenlab.llm.periodic import find_runs, z_function


def plain_runs(x, length=24, exponent=3):
    """(start, period, length) by comparing all words with all later ones."""
    n, out = len(x), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(length, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, q, n) for (s, n), q in out.items())


def plain_rest(x, runs):
    gone = {k for s, q, n in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(x) if k not in gone)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.3:
                x += [rng.randint(0, rng.choice([1, 2, 5, 100])) for _ in range(rng.randint(0, 120))]
            else:
                top = rng.choice([0, 1, 2, 9])
                p = [rng.randint(0, top) for _ in range(rng.randint(1, rng.choice([3, 10, 40, 90])))]
                x += (p * 12)[: rng.randint(1, len(p) * rng.randint(1, 11))]
        out.append(" ".join(f"w{k}" for k in x))
    return out


@pytest.mark.parametrize(
    "long,length,exponent",
    [(4_000_000, 24, 3), (400, 24, 3), (4_000_000, 6, 2), (0, 12, 4)],
)
def test_equal_to_comparing_all_words(spark, odd, odd_rows, long, length, exponent):
    texts = periodic_texts(long + length, 60)
    extra = spark.createDataFrame([(500 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    want = []
    for i, t in [*odd_rows, *((500 + k, t) for k, t in enumerate(texts))]:
        x = words(t)
        runs = plain_runs(x, length, exponent)
        rest = plain_rest(x, runs)
        want.append((str(i), len(x), runs, hashlib.sha256(rest.encode()).hexdigest(), rest))
    got = find_runs(docs, length=length, exponent=exponent, long_text=long).select(
        "row.doc_id", "n_words", "runs", "collapsed_sha256", "collapsed"
    )
    found = [(str(r[0]), r[1], [(x[0], x[1], x[2]) for x in r[2]], r[3], r[4]) for r in got.collect()]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("tile,length,exponent", [(16, 24, 3), (64, 24, 3), (16, 6, 2), (1 << 14, 12, 4)])
def test_tiles_alone(monkeypatch, tile, length, exponent):
    monkeypatch.setattr(periodic, "TILE", tile)
    for text in periodic_texts(tile, 80):
        ids = periodic.numbered(words(text))
        ends = {}
        for t in periodic.tiles(ids, length, exponent):
            assert len(t[2]) <= t[0].span + 2 * t[0].step + t[0].high
            for q, a, b in periodic.solve(*t, length, exponent):
                ends.setdefault(q, set()).update(range(a, b))
        for start, q, n in plain_runs(list(ids), length, exponent):
            assert ends[q].issuperset(range(start, start + n - q))
        for q, places in ends.items():
            assert all(ids[k] == ids[k + q] for k in places)


def test_tiles_of_one_document_go_to_many_tasks(spark):
    text = " ".join(f"w{k % 50_000}" for k in range(170_000)) + " x" * 30
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    rows = find_runs(docs, long_text=1000).select("runs").collect()
    assert [[tuple(x) for x in r["runs"]] for r in rows] == [[(0, 50_000, 170_000), (170_000, 1, 30)]] * 2


def test_z_function():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randint(0, 2) for _ in range(rng.randint(1, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert z_function(s) == want


def test_planted_periods(spark, odd, odd_rows):
    import zlib

    def plain(i, text):
        h = zlib.crc32(str(i).encode())
        g, x = h // 10, words(text)
        if i is None or h % 10 or text is None:
            return text
        if not x:
            return ""
        a = g % len(x)
        p = 1 + (len(x) - a) // (3 + g % 8)
        return " ".join(x[k] if k < a else x[a + (k - a) % p] for k in range(len(x)))

    many = spark.createDataFrame([(k, f"a b  c{k} d\ne f g h i j k l m") for k in range(300)], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(many)
    got = df.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    given = [*odd_rows, *((k, f"a b  c{k} d\ne f g h i j k l m") for k in range(300))]
    assert sorted((str(r[0]), r[1] or "") for r in got) == sorted((str(i), plain(i, t) or "") for i, t in given)


def test_empty_table(none):
    assert find_runs(none).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        find_runs(none, length=25)
