import random
import re

import pytest

from screenlab.llm.decontaminate import decontaminate, find_matches, words_hit


def words(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(window, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == x[k : k + n]:
                        hit |= set(range(a, a + n))
                        found.add(str(item))
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 30)))) for k in range(12)]
    items += [(50, "v1 v2 V3"), (51, None), (52, ""), (53, "Naïve日本 x-y"), (50, items[0][1])]
    docs = [(k, " ".join(rng.choice([*vocab, "other"]) for _ in range(rng.randint(0, 120)))) for k in range(40)]
    docs += [(100 + k, "before. " + items[k][1].upper() + ", after " + items[(k + 1) % 9][1]) for k in range(9)]
    docs += [(200, None), (201, ""), (202, items[3][1] * 1), (202, items[3][1]), (None, items[2][1] + " " + items[2][1])]
    return docs, items


def found(spark, case, **options):
    docs = spark.createDataFrame(case[0], "doc_id long, text string").repartition(3)
    docs = docs.selectExpr("*", "1 AS row", "2 AS matches", "3 AS _row")
    items = spark.createDataFrame(case[1], "item_id long, text string")
    df = find_matches(docs, items, **options).select("row.doc_id", "n_words", words_hit("matches").alias("n"), "matches")
    return sorted((str(r[0]), r[1], r[2], sorted({str(m["item"]) for m in r[3]})) for r in df.collect())


def test_equals_brute_force(spark, case):
    assert found(spark, case) == brute(*case)


def test_blocks_of_items_change_nothing(spark, case):
    assert found(spark, case, block=40) == brute(*case)


def test_matches_are_maximal_and_placed(spark):
    item = " ".join(f"i{k}" for k in range(25))
    doc = "x y " + " ".join(f"i{k}" for k in range(5, 20)) + " z"
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    assert [tuple(m) for m in find_matches(docs, items).first()["matches"]] == [(2, 15, "q", 5)]


def test_clean_rows_stay_whole(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)))], "item_id long, text string")
    left = decontaminate(odd, items)
    assert left.columns == odd.columns
    assert left.count() == odd.count() - 5
    assert decontaminate(odd, items.limit(0)).count() == odd.count()
    assert decontaminate(none, items).count() == 0


def test_many_items_and_texts_with_one_passage_need_little_memory():
    import tracemalloc

    import numpy as np

    from screenlab.llm import decontaminate

    passage = [b"w%d" % k for k in range(30)]
    block = decontaminate.TestBlock([(i, passage) for i in range(300)], 10)
    ids = [block.vocab[w] for w in passage] + [0]
    flat = np.array(ids * 2000 + [0], np.int64)
    tracemalloc.start()
    p, owner, q, size = decontaminate.longest_matches(flat, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == 600_000 and set(size.tolist()) == {30} and set((p % 31).tolist()) == {0}
    assert len(set(zip(p.tolist(), owner.tolist(), strict=True))) == 600_000
    assert peak < 200e6


def test_blocks_of_items_give_what_one_block_gives(spark, odd):
    items = [(k, " ".join(f"w{j}" for j in range(k, k + 15))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    from screenlab.llm.decontaminate import find_matches

    def rows(**options):
        got = find_matches(odd, bench, **options).select("row.doc_id", "n_words", "matches").collect()
        return sorted((str(r[0]), r[1], sorted(map(tuple, r[2]))) for r in got)

    one = rows()
    assert rows(block=60) == one and any(m for *_, m in one)
