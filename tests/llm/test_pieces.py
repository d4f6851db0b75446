import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from screenlab.llm.op13 import query
from screenlab.llm.pieces import Pieces, decode, encode, round_trip

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return Pieces(PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_equal_to_the_library(odd, odd_rows, library):
    def row(text):
        ids = library.encode(text or "", add_eos=True)
        return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))

    want = sorted((str(i), *row(t)) for i, t in odd_rows)
    got = round_trip(odd, PATH).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_query_over_whole_documents(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == digest(library.decode(ids))


def test_random_letters_and_pieces(own, library):
    rng = random.Random(1)
    letters = [*"aberst ▁\n\t\x00é日本語ÿ=(.01Á", "  ", " " * 17, "😀", "<0x41>", "<s>", "</s>", "in", "the", "com"]
    names = [own.names[k].replace("▁", " ") for k in own.ids.values()]
    for n in range(4000):
        source = letters if n % 2 else names
        text = "".join(rng.choice(source) for _ in range(rng.randint(0, 20)))
        ids = own.encode(text)
        assert ids == library.encode(text, add_eos=True), text
        assert own.decode(ids) == library.decode(ids)


def test_random_ids_decode_as_in_the_library(own, library):
    rng = random.Random(2)
    for _ in range(4000):
        pick = [rng.choice([rng.randrange(32000), rng.randrange(262), own.ids["▁"]]) for _ in range(rng.randint(0, 8))]
        assert own.decode(pick) == library.decode(pick), pick


@pytest.mark.parametrize("part,times", [("a", 30000), ("er", 20000), ("日本語", 10000), (" ", 30000), ("=\n", 5000)])
def test_long_texts_without_words(own, library, part, times):
    text = part * times
    assert own.encode(text) == library.encode(text, add_eos=True)


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr("screenlab.llm.pieces.REMEMBERED", 3)
    for text in ["one two three four five six", "six five four three two one", "un deux trois"]:
        assert own.encode(text) == library.encode(text, add_eos=True)


def test_steps_encode_and_decode(odd, odd_rows, library):
    ids = encode(odd, PATH, end=False)
    want = sorted((str(i), library.encode(t or "")) for i, t in odd_rows)
    assert sorted((str(r[0]), r[1]) for r in ids.select("row.doc_id", "ids").collect()) == want
    back = decode(ids.select("row.doc_id", "ids"), PATH).select("row.doc_id", "text").collect()
    assert sorted(map(str, (r["text"] for r in back))) == sorted(library.decode(x) for _, x in want)


def test_null_ids_strange_ids_and_empty_table(spark, none, own):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in decode(df, PATH).collect()] == ["", ""]
    assert round_trip(none, PATH).count() == 0
    assert encode(none, PATH).count() == 0
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode([32_000])
