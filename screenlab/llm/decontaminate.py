"""Benchmark decontamination with suffix arrays over the training documents.

Each task sorts the word suffixes of its documents shard by shard and binary
searches every suffix of the test items in them.  Only suffixes that can match
at all are kept in an array: words no test item has are 0, and a suffix whose
first words hold a 0 matches nothing.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlab.llm.common import shared_folder, written

WINDOW = 10
#: Pairs of equal windows of items and texts that are looked at together.
PAIRS = 1 << 20
#: Words of test items in one broadcast, and of documents in one suffix array.
BLOCK, SHARD = 400_000, 1_000_000

#: A-Z in lower case; what is not 0-9, a-z or outside ASCII separates words (fixed value).
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


class TestBlock:
    """Some test items as word numbers: the vocabulary, the words, the windows."""

    __test__ = False

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        flat: list[int] = []
        starts, sizes, owner = [], [], []
        self.begin = []
        for k, (_, words) in enumerate(items):
            at = len(flat)
            self.begin.append(at)
            flat += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            flat.append(0)
            n = min(window, len(words))
            found = range(at, at + len(words) - n + 1) if n else ()
            starts += found
            sizes += [n] * len(found)
            owner += [k] * len(found)
        self.flat = np.array(flat + [0], np.int64)
        self.start, self.size, self.owner = (np.array(x, np.int64) for x in (starts, sizes, owner))
        self.shortest = int(self.size.min()) if len(starts) else 0
        self.window = window
        low = suffix_keys(self.flat, self.start, window, self.size, 0)
        high = suffix_keys(self.flat, self.start, window, self.size, 0xFFFFFFFF)
        order = np.argsort(low, kind="stable")
        self.start, self.size, self.owner = self.start[order], self.size[order], self.owner[order]
        self.low, self.high = low[order], high[order]


def suffix_keys(flat: np.ndarray, at: np.ndarray, width: int, size: np.ndarray | int, fill: int) -> np.ndarray:
    """The first `width` words of each suffix as bytes that sort like the words; beyond `size`, `fill`."""
    out = np.empty((len(at), width), ">u4")
    for k in range(width):
        out[:, k] = np.where(k < size, flat[np.minimum(at + k, len(flat) - 1)], fill)
    return out.view(f"S{4 * width}").ravel()


def longest_matches(flat: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal verbatim matches of at least a window: place in `flat`, item, place in the block, words."""
    k = block.shortest
    total = np.r_[0, np.cumsum(flat > 0)]
    at = np.flatnonzero(total[k:] - total[:-k] == k)
    keys = suffix_keys(flat, at, block.window, block.window, 0)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    lo = np.searchsorted(keys, block.low, "left")
    n = np.searchsorted(keys, block.high, "right") - lo
    # A match that can be carried on to the left is found from its first word. Of a passage
    # that many items and texts share, all pairs are looked at, but never more than PAIRS at once.
    upto = np.cumsum(n)
    part = np.searchsorted(upto, np.arange(PAIRS, upto[-1] + PAIRS, PAIRS), "right") if len(n) else []
    ps, qs, whichs = [], [], []
    for a, b in zip([0, *part], [*part, len(n)], strict=True):
        own = n[a:b]
        which = np.repeat(np.arange(a, b), own)
        p = array[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(lo[a:b], own)]
        q = block.start[which]
        before = np.where((p > 0) & (q > 0), flat[np.maximum(p, 1) - 1], 0)
        first = (before == 0) | (before != block.flat[np.maximum(q, 1) - 1])
        ps.append(p[first])
        qs.append(q[first])
        whichs.append(which[first])
    p, q, which = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (ps, qs, whichs))
    size = block.size[which].copy()
    on = np.arange(len(p))
    while len(on):
        a = flat[np.minimum(p[on] + size[on], len(flat) - 1)]
        on = on[(a > 0) & (a == block.flat[np.minimum(q[on] + size[on], len(block.flat) - 1)])]
        size[on] += 1
    return p, block.owner[which], q, size


def _searched(block, names: list[str], kind: pa.DataType, batches: Iterator[pa.RecordBatch]):
    """Columns: row, text, words, matches; `block` is a broadcast."""
    block = block.value
    get = block.vocab.get

    def flush(shard: list[list[int]]) -> list[list[tuple]]:
        found: list[list[tuple]] = [[] for _ in shard]
        if not block.shortest or sum(map(len, shard)) < block.shortest:
            return found
        sizes = np.array([len(x) + 1 for x in shard])
        begin = np.cumsum(sizes) - sizes
        flat = np.zeros(sizes.sum() + 1, np.int64)
        for b, x in zip(begin, shard, strict=True):
            flat[b : b + len(x)] = x
        p, item, q, size = longest_matches(flat, block)
        doc = np.searchsorted(begin, p, "right") - 1
        for d, a, i, b, n in zip(doc.tolist(), (p - begin[doc]).tolist(), item.tolist(), q.tolist(), size.tolist()):
            found[d].append((a, n, block.ids[i], b - block.begin[i]))
        return found

    for batch in batches:
        n_words, matches = [], []
        shard, held = [], 0
        for text in batch.column(1).cast(pa.binary()):
            words = words_of(text.as_py() or b"")
            n_words.append(len(words))
            shard.append([get(w, 0) for w in words])
            held += len(words)
            if held > SHARD:
                matches += flush(shard)
                shard, held = [], 0
        matches += flush(shard)
        if len(names) > 3:
            earlier = batch.column(3).to_pylist()
            matches = [[tuple(m.values()) for m in a] + b for a, b in zip(earlier, matches, strict=True)]
        rows = [[dict(zip(("start", "words", "item", "item_start"), m, strict=True)) for m in ms] for ms in matches]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(rows, kind)],
            names=["_row", "_text", "_n", "_m"],
        )


def item_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block: int = BLOCK) -> Iterator[TestBlock]:
    """The test items in blocks of bounded size, streamed through the driver."""
    items, held = [], 0
    for i, x in benchmark.select(item_id, F.col(text).cast("binary")).toLocalIterator():
        words = words_of(bytes(x or b""))
        if items and held + len(words) > block:
            yield TestBlock(items, window)
            items, held = [], 0
        items.append((i, words))
        held += len(words)
    if items:
        yield TestBlock(items, window)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """(row, n_words, matches): the input row as a struct and its maximal matches.

    A match is (start, words, item, item_start), in words; it has at least
    `window` words, or all of an item that has fewer. Items are a stated query
    set: they go to the tasks in blocks of bounded size, each searched in a
    narrow map after the other, so nothing is shuffled and a hot passage only
    makes the rows longer that hold it. Null or wordless texts and items match
    nothing; an item without an id is searched like the others. Repeated rows
    are searched each for itself; without documents or items there are no
    matches. The row stays whole in its struct, so no column name can clash.
    """
    spark = docs.sparkSession
    item = benchmark.schema[item_id].dataType
    match = T.ArrayType(
        T.StructType(
            [
                T.StructField("start", T.LongType()),
                T.StructField("words", T.LongType()),
                T.StructField("item", item),
                T.StructField("item_start", T.LongType()),
            ]
        )
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(row.alias("_row"), F.col(text_col).alias("_text"))
    given = found.schema
    schema = T.StructType([*given, T.StructField("_n", T.LongType()), T.StructField("_m", match)])
    arrow = _arrow_type(item)
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item", arrow), ("item_start", pa.int64())])
    )
    blocks = item_blocks(benchmark, item_id, item_text, window, block)
    now, following = next(blocks, TestBlock([], window)), next(blocks, None)
    folder = None if following is None else shared_folder(spark)
    while now is not None:
        sent = spark.sparkContext.broadcast(now)
        found = found.mapInArrow(functools.partial(_searched, sent, found.columns, kind), schema)
        if folder is not None:
            # The driver holds one block and the next; what a block has found is written before it goes.
            found = written(found, folder, uuid.uuid4().hex)
            sent.destroy()
        now, following = following, next(blocks, None)
    return found.select(F.col("_row").alias("row"), F.col("_n").alias("n_words"), F.col("_m").alias("matches"))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StringType):
        return pa.string()
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()


def words_hit(matches: Column) -> Column:
    """Words inside any of the matches, each once."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), m["words"].alias("n"))))
    begin = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        upto = F.greatest(acc["upto"], s["a"] + s["n"])
        return F.struct(upto.alias("upto"), (acc["n"] + upto - F.greatest(acc["upto"], s["a"])).alias("n"))

    return F.aggregate(spans, begin, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs` without any match, with the columns of `docs`."""
    found = find_matches(docs, benchmark, **options)
    return found.filter(F.size("matches") == 0).select("row.*")
