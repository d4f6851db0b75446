"""Vector codes: every part of a vector as the number of its nearest codebook entry.

The entries are moved in rounds of exact integer arithmetic.  A few entries of
the first codebook are pivots for good: every part's distances to them are taken
once and stay with it.  In a round the pivots' distances to the entries are
taken, and the difference of the two is a lower bound of a part's distance to an
entry.  Entries are tried in order of their bounds, and only those whose bound
is no more than the best exact distance so far.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.llm.common import shared_folder, written

#: Vectors that are worked on at once; pivots of a part; entries tried between two looks at the bounds.
BLOCK, PIVOTS, TRIED = 1024, 8, 16
#: The largest component, so that squared distances of a part of 64 stay exact in 64 bits.
LARGEST = 1 << 27


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, row by row."""
    d = a - b
    return np.einsum("...k,...k->...", d, d)


def pivots_of(book: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Places of entries that lie far from each other: each next one is farthest from those before."""
    picked = [0]
    far = squared(book, book[0])
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, squared(book, book[picked[-1]]))
    return np.array(picked)


def nearest(parts: np.ndarray, away: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, of equal ones the first, and its squared distance.

    `away` has the parts' distances to the pivots. Roots are taken in floating
    point, so a bound is lowered by far more than their error before it cuts.
    """
    near = np.sqrt(squared(pivots[:, None], book[None]).astype(np.float64))
    bound = np.zeros((len(parts), len(book)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(away[:, p, None] - near[p]), out=bound)
    bound = np.maximum(bound * (1 - 1e-9) - 1e-6, 0)
    order = np.argsort(bound, axis=1)
    bound = np.take_along_axis(bound, order, 1)
    best = np.full(len(parts), np.iinfo(np.int64).max)
    entry = np.zeros(len(parts), np.int64)
    left = np.arange(len(parts))
    for at in range(0, len(book), TRIED):
        left = left[bound[left, at] <= np.sqrt(best[left].astype(np.float64))]
        if not len(left):
            break
        e = order[left, at : at + TRIED]
        d = squared(parts[left, None], book[e])
        least = d.min(1)
        first = np.where(d == least[:, None], e, len(book)).min(1)
        better = (least < best[left]) | ((least == best[left]) & (first < entry[left]))
        best[left[better]], entry[left[better]] = least[better], first[better]
    return entry, best


class Codebooks:
    """The entries of every part position, and the pivots taken from the first ones."""

    def __init__(self, entries: list[np.ndarray], pivots: list[np.ndarray] | None = None) -> None:
        self.entries = entries
        self.pivots = pivots or [book[pivots_of(book)] for book in entries]

    def away(self, parts: np.ndarray) -> np.ndarray:
        """Distances of (vectors, parts, components) to the pivots of their part, in a row a vector."""
        return np.concatenate(
            [np.sqrt(squared(parts[:, k, None], p[None]).astype(np.float64)) for k, p in enumerate(self.pivots)], axis=1
        )

    def assigned(self, parts: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every vector and part."""
        at = np.cumsum([0, *map(len, self.pivots)])
        found = [
            nearest(parts[:, k], away[:, at[k] : at[k + 1]], book, self.pivots[k])
            for k, book in enumerate(self.entries)
        ]
        return np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)

    def digest(self) -> str:
        """Of all components in decimal, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(x) for b in self.entries for x in b.ravel().tolist()).encode()).hexdigest()


def _blocks(parts: int, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(column), BLOCK):
        piece = column.slice(at, BLOCK)
        yield at, piece.flatten().to_numpy().reshape(len(piece), parts, -1)


def _with_distances(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, ints in _blocks(len(books.entries), batch.column(1)):
            away = pa.array(list(books.away(ints)), pa.list_(pa.float64()))
            rest = [c.slice(at, len(ints)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*rest, away], names=["row", "ints", "away"])


def _summed(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each entry used in the task: its parts' number and the sums of their components."""
    parts = len(books.entries)
    count = [np.zeros(len(b), np.int64) for b in books.entries]
    total = [np.zeros(b.shape, np.int64) for b in books.entries]
    for batch in batches:
        blocks = zip(_blocks(parts, batch.column(0)), _blocks(1, batch.column(1)), strict=True)
        for (_, ints), (_, away) in blocks:
            entry, _ = books.assigned(ints, away[:, 0])
            for k in range(parts):
                count[k] += np.bincount(entry[:, k], minlength=len(count[k]))
                np.add.at(total[k], entry[:, k], ints[:, k])
    out = [(k, e, int(count[k][e]), total[k][e]) for k in range(parts) for e in np.flatnonzero(count[k])]
    columns = [pa.array([x[c] for x in out], pa.int64()) for c in range(3)]
    yield pa.RecordBatch.from_arrays(
        [*columns, pa.array([x[3] for x in out], pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
    )


def _coded(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = zip(_blocks(len(books.entries), batch.column(1)), _blocks(1, batch.column(2)), strict=True)
        for (at, ints), (_, away) in blocks:
            entry, distance = books.assigned(ints, away[:, 0])
            code, error = pa.array(list(entry), pa.list_(pa.int64())), pa.array(distance.sum(1), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(ints)), code, error], names=["row", "code", "error"]
            )


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def vector_codes(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> tuple[DataFrame, Codebooks | None]:
    """(row, code, error) of every usable vector, and the codebooks.

    Components become floor(scale * x); a vector is cut into `parts` equal parts.
    A codebook starts as that part of the vectors with the `entries` smallest ids
    (equal ids by their components, null ids last). Each round gives every part its
    nearest entry and moves every used entry to the floor of its parts' mean;
    then parts are given their entries once more. `code` has an entry number a part,
    `error` the sum of the squared distances.

    Vectors that are null or hold a null or non-finite component are dropped;
    with fewer than `entries` vectors all are entries, and with none the result is
    empty and has no codebooks. Vectors of unequal length, of one that `parts`
    doesn't divide, or with components beyond LARGEST after scaling, are an error.
    Repeated rows stay. `row` carries all input columns.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    ints = F.transform(vector, lambda x: F.floor(x * scale).cast("long"))
    kept = df.filter(usable(vector)).select(row, ints.alias("ints"))
    big = F.exists(vector, lambda x: F.abs(x) * scale > LARGEST)
    size = F.size(vector)
    shape = (
        df.filter(usable(vector))
        .agg(F.min(size).alias("a"), F.max(size).alias("b"), F.coalesce(F.bool_or(big), F.lit(False)).alias("big"))
        .first()
    )
    schema = f"row {kept.schema['row'].dataType.simpleString()}"
    if shape["a"] is None:
        return kept.select("row", F.array().cast("array<long>").alias("code"), F.lit(0).cast("long").alias("error")), None
    if shape["a"] != shape["b"] or shape["a"] % parts or not shape["a"] or shape["big"]:
        raise ValueError("vectors must have one length that the parts divide, and components within bounds")
    order = [F.col(f"row.`{id_col}`").asc_nulls_last(), F.col("ints")]
    first = np.array([r["ints"] for r in kept.orderBy(*order).select("ints").limit(entries).collect()], np.int64)
    books = Codebooks(list(np.ascontiguousarray(first.reshape(len(first), parts, -1).swapaxes(0, 1))))
    table = written(
        kept.mapInArrow(functools.partial(_with_distances, books), f"{schema}, ints array<long>, away array<double>"),
        shared_folder(df.sparkSession),
        "parts",
    )
    width = first.shape[1] // parts
    for _ in range(rounds):
        sums = table.select("ints", "away").mapInArrow(
            functools.partial(_summed, books), "part long, entry long, n long, total array<long>"
        )
        # At most parts * entries rows, whatever the input.
        moved = sums.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(width)]).alias("total")
        )
        fresh = [b.copy() for b in books.entries]
        for r in moved.collect():
            fresh[r["part"]][r["entry"]] = [x // r["n"] for x in r["total"]]
        books = Codebooks(fresh, books.pivots)
    coded = table.mapInArrow(functools.partial(_coded, books), f"{schema}, code array<long>, error long")
    return coded, books
