import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from screenlab.llm.bpe import Coder, decode, encode, round_trip

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(odd, odd_rows, library):
    def digests(text):
        ids = library.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        return ids, hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()

    want = sorted((str(i), *digests(t)) for i, t in odd_rows)
    got = round_trip(odd, PATH, P.PATTERN).select("row.doc_id", "ids", "ids_sha256", "decoded_sha256")
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_steps_encode_and_decode(odd, odd_rows):
    ids = encode(odd, PATH, P.PATTERN).select("row.doc_id", "ids")
    back = decode(ids, PATH, P.PATTERN).select("row.doc_id", "bytes").collect()
    want = sorted((str(i), (t or "").encode()) for i, t in odd_rows)
    assert sorted((str(r[0]), bytes(r[1])) for r in back) == want


def test_long_pretokens_and_repeats_of_a_pair(library):
    own = Coder(PATH, P.PATTERN)
    texts = ["ab" * 300, "a" * 500, "中文日本語" * 300, "=" * 400, "aaaa aaa  \n\n  aa"]
    assert [list(x) for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    own.known.clear()
    own.forget()
    assert [list(x) for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_unknown_id_is_an_error():
    own = Coder(PATH, P.PATTERN)
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode([[999_999]])


def test_null_ids_and_empty_table(spark, none):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    rows = decode(df, PATH, P.PATTERN).select("row.doc_id", "bytes").orderBy(F.col("doc_id")).collect()
    assert [bytes(r["bytes"]) for r in rows] == [b"", b"", b'!"']
    assert round_trip(none, PATH, P.PATTERN).count() == 0


def test_text_of_eleven_million_letters(library):
    own = Coder(PATH, P.PATTERN)
    unit = "".join(f"word{k % 977} of a long text, line {k % 31}\n" for k in range(2000)) + "日本語 " * 50
    text = unit * (11_200_000 // len(unit) + 1)
    ids = own.encode([text])[0]
    assert len(text) > 11_000_000 and ids.tolist() == library.encode_ordinary(text)
    assert own.decode([ids])[0] == text.encode()


def test_a_long_text_among_short_ones(spark, library, monkeypatch):
    from screenlab.llm import bpe

    monkeypatch.setattr(bpe, "CHUNK", 50)
    import pyarrow as pa

    texts = ["a b", None, "c" * 30, "long text " * 40, "", "d e f", "x" * 51]
    parts = list(bpe._chunks(pa.array(texts)))
    assert [x for p in parts for x in p] == [t or "" for t in texts]
    assert all(len(p) == 1 or sum(map(len, p)) <= 50 for p in parts)
    own = bpe.Coder(PATH, P.PATTERN)
    ids = [x for p in parts for x in own.encode(p)]
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t or "") for t in texts]
    assert b"".join(own.decode([x])[0] for x in ids) == "".join(t or "" for t in texts).encode()
