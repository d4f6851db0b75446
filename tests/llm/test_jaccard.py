import random
import re

from screenlab.llm import jaccard
from screenlab.llm.jaccard import near_components, one_of_each


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return sorted(
        ((str(i), len(sets[k]), first.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str
    )


def got(df, **options):
    return sorted(((str(r["id"]), r["n_shingles"], r["component_id"]) for r in near_components(df, **options).collect()), key=str)


def family(rng, n, copies, edits, start):
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for k in range(copies):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(n)] = f"e{rng.randint(0, 10**6)}"
        rows.append((start + k, " ".join(words)))
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for f in range(10):
        rows += family(rng, rng.choice([4, 6, 30, 80]), rng.randint(1, 8), 4, 100 * f)
    shared = " ".join(f"s{k}" for k in range(40))
    rows += [(2000 + k, shared + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60))) for k in range(20)]
    rows += [rows[0], (5000, None), (5001, ""), (5002, " \n"), (5003, "Hi"), (5004, "hI"), (None, rows[3][1]), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_large_family_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 8)
    rows = family(random.Random(4), 60, 90, 4, 0) + family(random.Random(5), 50, 20, 9, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)


def test_rounds_read_the_texts_once(spark, monkeypatch):
    """Rounds for large keys take the sets of candidates from one table, and end when they join no more."""
    monkeypatch.setattr(jaccard, "LARGE", 8)
    monkeypatch.setattr(jaccard, "PAIRS", 0)
    made, rounds = [], []
    sets_of, fellows = jaccard._Join.sets_of, jaccard._Join.fellows
    monkeypatch.setattr(jaccard._Join, "sets_of", lambda *x: made.append(1) or sets_of(*x))
    monkeypatch.setattr(jaccard._Join, "fellows", lambda *x: rounds.append(1) or fellows(*x))
    rng = random.Random(6)
    rows = family(rng, 60, 60, 4, 0)
    # Sets that share rare shingles and are not alike: no round joins them.
    shared = " ".join(f"s{k}" for k in range(6))
    rows += [(500 + k, shared + " " + " ".join(f"u{rng.randint(0, 9)}" for _ in range(30))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)
    assert len(made) == 1 and 1 <= len(rounds) < jaccard.ROUNDS


def test_few_pairs_of_a_family_are_compared(spark, monkeypatch):
    """Of a family without a text that all are like, bits leave out nearly all pairs that are not alike."""
    monkeypatch.setattr(jaccard, "BLOCK", 40, raising=False)
    compared = []
    alike = jaccard._Join.alike

    def counted(join, sets, pairs):
        out = alike(join, sets, pairs)
        compared.append((out.filter("NOT linked").count(), sets.count()))
        return out

    monkeypatch.setattr(jaccard._Join, "alike", counted)
    rng = random.Random(3)
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for k in range(300):
        words = base[:]
        for at in rng.sample(range(150), rng.choice([2, 3, 3, 3])):
            words[at] = f"e{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)
    # Rounds hold a set against FELLOWS others; what comes after them is less than that.
    last, sets = compared[-1]
    assert sets == 300 and last <= jaccard.FELLOWS * sets


def test_sets_have_as_many_bits_as_others_of_their_band():
    x = jaccard.shingles(" ".join(f"w{k}" for k in range(154)), jaccard._Known())
    for band in (0, 20, 22, 23, 60):
        m = jaccard.marks(x, band, 80)
        assert len(m) in (1, 8, 16, 256) and int(jaccard.np.bitwise_count(m.view(jaccard.np.uint64)).sum()) <= len(x)
    assert len(jaccard.marks(x[:140], 22, 80)) == len(jaccard.marks(x, 22, 80))


def test_other_similarity(spark):
    rows = family(random.Random(9), 40, 15, 6, 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    high = {r[2] for r in got(df, percent=95)}
    low = {r[2] for r in got(df, percent=50)}
    assert len(high) >= len({r[2] for r in brute(rows)}) >= len(low)


def test_one_of_each(odd, odd_rows, none):
    assert got(odd) == brute(odd_rows)
    left = one_of_each(odd)
    assert left.columns == odd.columns
    want = {c for i, n, c in brute(odd_rows) if n} | {i for i, t in odd_rows if not (t or "").strip()}
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(want) and {i for i in ids if i is not None} <= want
    assert one_of_each(none).count() == 0
