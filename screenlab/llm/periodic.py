"""Periodic runs of words, by tiles of every period octave.

A text's words become numbers.  For each octave of periods they are cut into
tiles that overlap by as much as one look of that octave takes.  Tiles are solved
one by one: at boundaries so close that every run holds one with a whole block
after it, blocks of equal hash a period apart are looked up, and where there are
some, Z-functions to both sides of the boundary give exactly how far words agree
with those a period later.  These fragments are shuffled by document and period
and stitched; of equal stretches the smallest period stays.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlab.llm.common import shared_folder, written

#: Words: runs of anything but six ASCII blanks (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a tile, besides its overlap; letters of a text whose tiles are dealt out
#: to other tasks; letters of text in one output batch.
TILE, LONG_TEXT, CHUNK = 1 << 14, 4_000_000, 3_000_000

_words = re.compile(WORD).findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Octave(NamedTuple):
    """Periods low..high, looked for at multiples of `step` by blocks of `step` words."""

    low: int
    high: int
    step: int

    @property
    def span(self) -> int:
        """Words whose boundaries one tile owns."""
        return max(1, TILE // self.step) * self.step


def octaves(n: int, length: int, exponent: int) -> Iterator[Octave]:
    """The octaves of periods that n words can hold runs of.

    A run of period q has max(length, exponent * q) words at least. With steps of
    (exponent - 1) / 2 of the smallest period it holds a boundary with a block
    after it, and the same block q words later.
    """
    low, high = 1, length // exponent
    step = max(1, high * (exponent - 1) // 2)
    while max(length, exponent * low) <= n:
        yield Octave(low, high, step)
        if low > 1:
            step *= 2
        low, high = high + 1, high * 2


def tiles(ids: np.ndarray, length: int, exponent: int) -> Iterator[tuple[Octave, int, np.ndarray]]:
    """(octave, first word owned, words): a step more to the left, all that its looks reach to the right."""
    for o in octaves(len(ids), length, exponent):
        for at in range(0, len(ids) - o.low - o.step + 1, o.span):
            yield o, at, ids[max(0, at - o.step) : at + o.span + o.step + o.high]


@functools.lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full((1 << bits) - 1, b, np.uint64)]) for b in (_BASE, inverse))


def _blocks(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every block of `size` words: equal for equal ones, and hardly ever else."""
    power, inverse = _powers(max(14, len(ids).bit_length()))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mixed * power[: len(ids)], out=total[1:])
    return (total[size:] - total[:-size]) * inverse[: len(ids) - size + 1]


def z_function(s: list[int]) -> list[int]:
    """How many values from each place on agree with the first ones."""
    n = len(s)
    z, left, right = [n] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(o: Octave, at: int, ids: np.ndarray, length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of a tile's fragments: words start..end-1 agree with those a period later.

    Fragments too short for a run stay only where they may go on in another tile.
    """
    own = min(at, o.step)
    if len(ids) < own + o.low + o.step:
        return []
    block = _blocks(ids, o.step)
    bounds = np.arange(own, min(own + o.span, len(block) - o.low), o.step)
    width = o.high - o.low + 1
    padded = np.concatenate([block, np.zeros(width, np.uint64)])
    equal = sliding_window_view(padded, width)[bounds + o.low] == block[bounds, None]
    row, period = np.nonzero(equal)
    period += o.low
    inside = bounds[row] + period < len(block)
    found: dict[int, list[list[int]]] = {}
    looks: dict[int, list[int]] = {}
    for c, q in zip(bounds[row[inside]].tolist(), period[inside].tolist(), strict=True):
        looks.setdefault(c, []).append(q)
    for c, periods in looks.items():
        most = periods[-1]
        ahead = z_function(ids[c : c + most + 2 * o.step].tolist())
        before = ids[max(0, c - o.step) : c][::-1].tolist()
        behind = z_function([*before, -1, *ids[c - len(before) : c + most][::-1].tolist()])
        for q in periods:
            right = min(ahead[q], 2 * o.step)
            if right < o.step:  # other words of the same hash
                continue
            start, end = c - min(behind[len(before) + 1 + most - q], len(before)), c + right
            last = found.setdefault(q, [[start, end]])[-1]
            if start <= last[1]:
                last[1] = max(last[1], end)
            else:
                found[q].append([start, end])
    shift = at - own
    return [
        (q, start + shift, end + shift)
        for q, stretches in found.items()
        for start, end in stretches
        if end - start + q >= max(length, exponent * q) or (at and start < own) or end > own + o.span
    ]


def numbered(words: list[str]) -> np.ndarray:
    """Equal numbers for equal words."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def collapsed(words: list[str], runs: list[dict]) -> str:
    """The words, without those that a run holds after its first period, joined by spaces."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r["start"] + r["period"]] += 1
        change[r["start"] + r["length"]] -= 1
    inside = np.cumsum(change)
    return " ".join(w for w, k in zip(words, inside.tolist(), strict=False) if not k)


_FRAGMENTS = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batches in parts of bounded text, and the texts, which stand in the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        start = total = 0
        for k, text in enumerate(texts):
            size = text.as_buffer().size if text.is_valid else 0
            if k > start and total + size > CHUNK:
                yield batch.slice(start, k - start), texts.slice(start, k - start).to_pylist()
                start, total = k, 0
            total += size
        yield batch.slice(start), texts.slice(start).to_pylist()


def _scanned(
    length: int, exponent: int, whole: bool, long_text: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for part, texts in _parts(batches):
        n, fragments, kept, digests, plain = [], [], [], [], []
        for text in texts:
            words = _words(text or "")
            n.append(len(words))
            if text and len(text) > long_text:
                found = None
            elif len(words) < length:
                found = []
            else:
                cut = tiles(numbered(words), length, exponent)
                found = [x for tile in cut for x in solve(*tile, length, exponent)]
            fragments.append(found and [dict(zip(("period", "start", "end"), x, strict=True)) for x in found])
            settled = " ".join(words) if found == [] else None
            kept.append(text if settled is None else None)
            digests.append(settled if settled is None else _sha(settled))
            plain.append(settled if whole else None)
        columns = [
            pa.array(n, pa.int64()),
            pa.array(fragments, _FRAGMENTS),
            pa.array(digests, pa.string()),
            pa.array(plain, pa.string()),
            pa.array(kept, pa.string()),
        ]
        names = ["_row", "_n", "_fragments", "_digest", "_collapsed", "_text"]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)


def _cut(length: int, exponent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for o, at, ids in tiles(numbered(_words(text.as_py())), length, exponent):
                columns = [pa.array([x], pa.int64()) for x in (key, *o, at)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([ids], pa.list_(pa.int32()))],
                    names=["at", "low", "high", "step", "first", "ids"],
                )


def _solved(length: int, exponent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(5)
        heads = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
        out = [
            (key, *x)
            for k, (key, low, high, step, first) in enumerate(heads)
            for x in solve(Octave(low, high, step), first, ids[k].values.to_numpy(), length, exponent)
        ]
        columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "period", "start", "end"])


def _without(whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _parts(batches):
        plain = [
            collapsed(_words(text), runs or [])
            for text, runs in zip(texts, part.column(2).to_pylist(), strict=True)
        ]
        given = pa.array(plain if whole else [None] * len(plain), pa.string())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2), pa.array(list(map(_sha, plain)), pa.string()), given],
            names=["row", "n_words", "runs", "collapsed_sha256", "collapsed"],
        )


_RUNS = "array<struct<start:long,period:long,length:long>>"


def find_runs(
    docs: DataFrame,
    text_col: str = "text",
    length: int = 24,
    exponent: int = 3,
    texts: bool = True,
    long_text: int = LONG_TEXT,
) -> DataFrame:
    """(row, n_words, runs, collapsed_sha256, collapsed): the periodic runs of every text's words.

    A run is a longest stretch of words with smallest period q, words q apart being
    equal, of `length` words and `exponent` * q at least; `length` is a multiple of
    `exponent`. `runs` holds (start, period, length) by start, then period, word
    numbers from 0. `collapsed` joins by spaces the words that no run holds after
    its first q words; without `texts` it is null and only its digest is given. The tiles of a text of more than
    `long_text` letters are dealt out to all tasks, those of others are solved where
    the text is read.

    A null or empty text, or one of fewer words than `length`, has no runs. Repeated
    rows each come back; columns of any name are carried in `row`; an empty table
    gives an empty one.
    """
    if exponent < 2 or length % exponent:
        raise ValueError("length must be a multiple of an exponent of 2 or more")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    given = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("_text"))
    head = given.select("_row").schema.simpleString()[len("struct<_row:") : -1]
    scanned = given.mapInArrow(
        functools.partial(_scanned, length, exponent, texts, long_text),
        f"_row {head}, _n long, _fragments array<struct<period:long,start:long,end:long>>,"
        " _digest string, _collapsed string, _text string",
    )
    # One number a row, for good: from here on it is read from the table.
    kept = written(scanned.withColumn("_at", F.monotonically_increasing_id()), shared_folder(docs.sparkSession), "scan")
    some = kept.filter("_digest IS NULL")
    near = some.select(F.col("_at").alias("at"), F.inline("_fragments").alias("period", "start", "end"))
    cut = some.filter("_fragments IS NULL").select("_at", "_text")
    cut = cut.mapInArrow(
        functools.partial(_cut, length, exponent),
        "at long, low long, high long, step long, first long, ids array<int>",
    )
    far = cut.repartition("at", "low", "first").mapInArrow(
        functools.partial(_solved, length, exponent), "at long, period long, start long, end long"
    )
    runs = stitched(near.unionByName(far), length, exponent)
    joined = some.join(runs, F.col("_at") == F.col("at"), "left")
    ended = joined.select("_row", F.col("_n"), F.coalesce("runs", F.array().cast(_RUNS)).alias("_runs"), "_text")
    schema = f"row {head}, n_words long, runs {_RUNS}, collapsed_sha256 string, collapsed string"
    held = ended.mapInArrow(functools.partial(_without, texts), schema)
    free = kept.filter("_digest IS NOT NULL").select(
        F.col("_row").alias("row"),
        F.col("_n").alias("n_words"),
        F.array().cast(_RUNS).alias("runs"),
        F.col("_digest").alias("collapsed_sha256"),
        F.col("_collapsed").alias("collapsed"),
    )
    return held.unionByName(free)


def stitched(fragments: DataFrame, length: int = 24, exponent: int = 3) -> DataFrame:
    """(at, runs) of fragments (at, period, start, end): those that touch joined, then the smallest periods."""
    of = Window.partitionBy("at", "period").orderBy("start", "end")
    before = F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        fragments.withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("long"))
        .withColumn("nth", F.sum("fresh").over(of))
        .groupBy("at", "period", "nth")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("length", F.col("end") - F.col("start") + F.col("period"))
        .filter(F.col("length") >= F.greatest(F.lit(length), F.lit(exponent) * F.col("period")))
        .groupBy("at", "start", "length")
        .agg(F.min("period").alias("period"))
    )
    return runs.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
