"""Byte-level BPE encoding and decoding by recursive queries inside each partition.

A task holds its distinct pre-tokens as rows (segment, place, token) of an
in-memory DuckDB.  A recursive query joins neighbouring tokens with the merge
table and contracts the leftmost lowest-ranked pair of every segment until none
has one.  Ordered aggregation puts the tokens of a document in a row, and turns
tokens back into bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of text in one round of queries, and pre-tokens a worker remembers.
CHUNK, REMEMBERED = 3_000_000, 400_000
#: Contractions of a segment in one recursive query; longer ones take several.
STEPS = 48

#: Every step passes on all rows of the segments that were contracted in it.
_CONTRACT = f"""
WITH RECURSIVE state(step, seg, place, id, more) AS (
  SELECT 0, seg, place, id, true FROM todo
  UNION ALL (
    WITH pairs AS (
      SELECT s.*, merges.made FROM (
        SELECT *, lead(id) OVER w AS next, lag(place) OVER w AS before FROM state WHERE more AND step < {STEPS}
        WINDOW w AS (PARTITION BY seg ORDER BY place)
      ) s LEFT JOIN merges ON merges.pair = ((s.id::BIGINT << 20) | s.next)
    ), lowest AS (
      SELECT seg, min((made::BIGINT << 32) | place) AS best FROM pairs GROUP BY seg
    ), marked AS (
      SELECT pairs.*, best, best & 4294967295 AS spot FROM pairs JOIN lowest USING (seg)
    )
    SELECT step + 1, seg, place, CASE WHEN place = spot THEN made ELSE id END, best IS NOT NULL
    FROM marked WHERE before IS NULL OR spot IS NULL OR before <> spot
  )
)
SELECT seg, place, id, more FROM state WHERE NOT more OR step = {STEPS}
"""


class Coder:
    """The ranks of a vocabulary file, in a DuckDB of one worker process."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            tokens = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        rank = dict(tokens)
        self.first = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.pieces = self.pattern.findall
        # No token holds some pairs of bytes, so no contraction crosses them.
        self.meets = np.zeros((256, 256), bool)
        splits = []
        for token, made in tokens:
            raw = np.frombuffer(token, np.uint8)
            self.meets[raw[:-1], raw[1:]] = True
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    splits.append(((a << 20) | b, made))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.store("merges", pair=np.array([p for p, _ in splits], np.int64), made=np.array([m for _, m in splits]))
        vocab = pa.table({"id": [r for _, r in tokens], "hex": [t.hex() for t, _ in tokens]})
        self.db.register("_vocab", vocab)
        self.db.execute("CREATE TABLE vocab AS SELECT id::INTEGER AS id, hex FROM _vocab")
        self.forget()

    def store(self, name: str, **columns: np.ndarray) -> None:
        self.db.register("_new", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _new")
        self.db.unregister("_new")

    def rows(self, sql: str) -> pa.Table:
        return self.db.sql(sql).to_arrow_table()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.db.execute("CREATE OR REPLACE TABLE known (word INTEGER, place INTEGER, id INTEGER)")

    def learn(self, words: list[str]) -> None:
        """Contract new pre-tokens to their fixpoint and remember their tokens."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        begin = np.cumsum(size) - size
        apart = np.zeros(len(raw), bool)
        apart[1:] = ~self.meets[raw[:-1], raw[1:]]
        apart[begin] = True
        seg, place, ids = np.cumsum(apart), np.arange(len(raw)), self.first[raw]
        done = []
        while len(seg):
            self.store("todo", seg=seg.astype(np.int32), place=place.astype(np.int32), id=ids)
            out = self.rows(_CONTRACT)
            more = out.column("more").to_numpy()
            seg, place, ids = (out.column(c).to_numpy() for c in ("seg", "place", "id"))
            done.append((place[~more], ids[~more]))
            seg, place, ids = seg[more], place[more], ids[more]
        place, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        word = np.searchsorted(begin, place, "right") - 1
        start = len(self.known)
        self.known.update(zip(words, range(start, start + len(words)), strict=True))
        self.db.register("_new", pa.table({"w": word + start, "p": place - begin[word], "id": ids}))
        self.db.execute("INSERT INTO known SELECT w, p, id FROM _new")
        self.db.unregister("_new")

    def windows(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of about CHUNK letters."""
        words, size = [], 0
        for match in self.pattern.finditer(text):
            words.append(match.group())
            size += len(words[-1])
            if size >= CHUNK:
                yield words
                words, size = [], 0
        yield words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text; one longer than a chunk goes through the queries in parts."""
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            return [np.concatenate([self.encode_words([words])[0] for words in self.windows(texts[0])])]
        return self.encode_words([self.pieces(t) for t in texts])

    def encode_words(self, split: list[list[str]]) -> list[np.ndarray]:
        """The token ids of each list of pre-tokens."""
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh = list(set(chain.from_iterable(split)).difference(self.known))
        if fresh:
            self.learn(fresh)
        size = np.array([len(words) for words in split], np.int64)
        word = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int32, size.sum())
        self.store(
            "occurs",
            doc=np.repeat(np.arange(len(split), dtype=np.int32), size),
            nth=np.arange(len(word), dtype=np.int64),
            word=word,
        )
        found = self.rows(
            "SELECT doc, list(id ORDER BY (nth << 32) | place) AS ids FROM occurs JOIN known USING (word) GROUP BY doc"
        )
        return _by_number(found, len(split), np.zeros(0, np.int32))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids, a long one in parts; an id the vocabulary lacks is an error."""
        if len(ids) == 1 and len(ids[0]) > CHUNK // 3:
            parts = (ids[0][k : k + CHUNK // 3] for k in range(0, len(ids[0]), CHUNK // 3))
            return [b"".join(self.decode([part])[0] for part in parts)]
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        self.store("told", doc=np.repeat(np.arange(len(ids), dtype=np.int32), size), nth=np.arange(len(flat)), id=flat)
        found = self.rows(
            "SELECT doc, count(*) AS n, unhex(string_agg(hex, '' ORDER BY nth)) AS bytes"
            " FROM told JOIN vocab USING (id) GROUP BY doc"
        )
        if sum(found.column("n").to_pylist()) != len(flat):
            raise ValueError("ids outside the vocabulary")
        out = [b""] * len(ids)
        for d, x in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist(), strict=True):
            out[d] = x
        return out


def _by_number(found: pa.Table, n: int, empty: np.ndarray) -> list[np.ndarray]:
    out = [empty] * n
    for batch in found.to_batches():
        lists = batch.column(1)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k, d in enumerate(batch.column(0).to_pylist()):
            out[d] = flat[ends[k] : ends[k + 1]]
    return out


@functools.lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _chunks(column: pa.Array) -> Iterator[list]:
    """Texts of CHUNK letters together at most, or one longer one."""
    part, held = [], 0
    for x in column:
        text = x.as_py() or ""
        if part and held + len(text) > CHUNK:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def _encoded(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = coder(path, pattern)
    for batch in batches:
        at = 0
        for texts in _chunks(batch.column(1)):
            ids = own.encode(texts)
            rows = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), rows], names=["_row", "_ids"])
            at += len(texts)


def _decoded(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = coder(path, pattern)
    for batch in batches:
        ends = np.r_[0, np.cumsum(np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)))]
        at = 0
        while at < len(batch):
            # At least one row, and as many more as fit.
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK // 3, "right")) - 1)
            part = batch.slice(at, upto - at)
            ids = [np.array(x.values.to_numpy() if x.is_valid else [], np.int32) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(own.decode(ids), pa.binary())],
                names=["_row", "_ids", "_bytes"],
            )
            at = upto


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(row, ids): each input row as a struct and the token ids of its whole text.

    `path` is a file of base64 tokens and ranks that executors can read, and
    `pattern` splits texts before merging. Null and empty texts have no ids.
    Every row is encoded by itself in a narrow map: repeated rows, null ids and
    further columns pass through in the struct, so no name can clash, and an
    empty table gives an empty one. Chunks of a few million letters bound the
    rows in a worker's database; a longer text is a chunk of its own. A pre-token
    without impossible byte pairs takes time by the square of its length.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("_row"), F.col(text_col).alias("_text"))
    schema = T.StructType([given.schema["_row"], T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    out = given.mapInArrow(functools.partial(_encoded, path, pattern), schema)
    return out.select(F.col("_row").alias("row"), F.col("_ids").alias("ids"))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """(row, ids, bytes): each input row as a struct without its ids, the ids, and their bytes.

    Null and empty ids give no bytes; an id outside the vocabulary is an error.
    """
    rest = [c for c in df.columns if c != ids_col]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    given = df.select(row.alias("_row"), F.col(ids_col).cast("array<int>").alias("_ids"))
    schema = T.StructType([*given.schema, T.StructField("_bytes", T.BinaryType())])
    out = given.mapInArrow(functools.partial(_decoded, path, pattern), schema)
    return out.select(F.col("_row").alias("row"), F.col("_ids").alias("ids"), F.col("_bytes").alias("bytes"))


def _round_trip(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = coder(path, pattern)
    for batch in batches:
        at = 0
        for texts in _chunks(batch.column(1)):
            ids = own.encode(texts)
            told = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(x).hexdigest() for x in own.decode(ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(told),
                    pa.array(back),
                ],
                names=["_row", "_ids", "_told", "_back"],
            )
            at += len(texts)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(row, ids, ids_sha256, decoded_sha256): `encode` and `decode` in one pass over the texts.

    Digests are of the ids as little-endian unsigned 32-bit integers, and of the
    bytes the ids decode to. Both steps share a worker and its database.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("_row"), F.col(text_col).alias("_text"))
    digests = [T.StructField("_told", T.StringType()), T.StructField("_back", T.StringType())]
    schema = T.StructType([given.schema["_row"], T.StructField("_ids", T.ArrayType(T.IntegerType())), *digests])
    out = given.mapInArrow(functools.partial(_round_trip, path, pattern), schema)
    names = {"_row": "row", "_ids": "ids", "_told": "ids_sha256", "_back": "decoded_sha256"}
    return out.withColumnsRenamed(names)
