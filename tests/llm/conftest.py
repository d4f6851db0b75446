"""Documents with every oddity the operators have a defined result for."""

import random

import pytest

#: Column names the operators use inside, and their values here.
CLASHING = {"row": 1, "_row": 2, "_text": "x", "_id": 3, "k": 4, "n": 5, "score": 0.5, "matches": "m", "ids": "i"}


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(7)
    words = ["the", "of", "and", "Alpha", "beta", "gämma", "delta", "x1", "***", "日本", "it's"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30", "zz")
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b "),
        (4, "one"),
        (5, base),
        (6, near),
        (7, base),
        (7, base),
        (8, long),
        (9, "a a a a a a a a a a a a\n\nb b\nb b\n"),
        (None, base + " tail"),
        (10, "THE QUICK BROWN fox <|endoftext|> jumps over 12345 'll !!"),
    ]
    rows += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for k in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(v) for c, v in CLASHING.items()})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
