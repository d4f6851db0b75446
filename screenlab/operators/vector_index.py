"""Approximate nearest neighbours: cells of short codes, the best of them compared exactly.

An index is fitted on a bounded sample: centres of cells, and a codebook for every
part of what is left of a vector when its centre is taken off.  All vectors are
indexed, each as its cell and one byte a part.  A query looks into its nearest
cells and sums up table entries there instead of comparing vectors; the ``keep``
rows that seem nearest are then compared exactly.  Codes, not vectors, travel to
the queries.  How many cells it takes is chosen on the sample and measured by
`recall` on the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that an index is fitted on, at most; rows of a cell, and queries, that one task takes at once.
SAMPLE, PIECE = 20_000, 4096


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(-1)[:, None] + (b * b).sum(-1)[None] - 2 * (a @ b.T), 0)


def _means(points: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most ``count`` clusters of the points."""
    found = points[rng.permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        nearest = _squares(points, found).argmin(1)
        size = np.bincount(nearest, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, nearest, points)
        found[size > 0] = total[size > 0] / size[size > 0, None]
    return found


@dataclass(frozen=True)
class VectorIndex:
    centres: np.ndarray
    entries: np.ndarray
    probes: int

    def cells(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        return np.argsort(_squares(vectors, self.centres), axis=1, kind="stable")[:, :count]

    def codes(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """One byte a part: the nearest entry to that part of what the centre leaves."""
        parts, _, width = self.entries.shape
        rest = (vectors - self.centres[cells]).reshape(len(vectors), parts, width)
        return np.stack([_squares(rest[:, p], self.entries[p]).argmin(1) for p in range(parts)], 1).astype(np.uint8)

    def rough(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the vectors of a cell, as far as their codes tell."""
        parts, _, width = self.entries.shape
        rest = (queries - self.centres[cell]).reshape(len(queries), parts, width)
        total = np.zeros((len(queries), len(codes)), np.float32)
        for p in range(parts):
            total += _squares(rest[:, p], self.entries[p]).astype(np.float32)[:, codes[:, p]]
        return total


def fit_index(
    corpus: DataFrame, k: int = 10, cells: int = 64, parts: int = 32, recall: float = 0.95, seed: int = 0
) -> VectorIndex:
    """An index of corpus(id, vec), fitted on the SAMPLE rows first in hash order of their id.

    ``probes`` becomes the smallest number of cells that holds ``recall`` of the k
    nearest neighbours among the sample, for 256 of its vectors.
    """
    rows = corpus.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vec").collect()
    if not rows:
        raise ValueError("an empty corpus has no neighbours")
    points = np.array([r.vec for r in rows], dtype=np.float64)
    rng = np.random.default_rng(seed)
    width = points.shape[1]
    parts = next(p for p in range(min(parts, width), 0, -1) if width % p == 0)
    centres = _means(points, min(cells, max(1, len(points) // 8)), 10, rng)
    at = _squares(points, centres).argmin(1)
    rest = (points - centres[at]).reshape(len(points), parts, -1)
    entries = np.stack([_means(rest[:, p], min(256, len(points)), 10, rng) for p in range(parts)])
    index = VectorIndex(centres, entries, len(centres))
    asked = points[:256]
    apart = _squares(asked, points)
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1)[:, : min(k, max(len(points) - 1, 1))]
    order = index.cells(asked, len(centres))
    place = np.argsort(order, axis=1)  # of each cell in the query's order
    depth = np.sort(np.take_along_axis(place, at[near], 1).ravel())
    probes = 1 + int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)])
    return VectorIndex(centres, entries, min(probes, len(centres)))


def index_rows(index: VectorIndex, corpus: DataFrame) -> DataFrame:
    """(id, cell, code) of every corpus row."""

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = _matrix(pdf["vec"])
                cell = index.cells(vectors, 1)[:, 0]
                code = [c.tobytes() for c in index.codes(vectors, cell)]
                yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype(np.int32), "code": code})

    kind = corpus.schema["id"].dataType.simpleString()
    return corpus.select("id", "vec").mapInPandas(coded, f"id {kind}, cell int, code binary")


def search_index(
    index: VectorIndex,
    rows: DataFrame,
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    keep: int | None = None,
    exclude_self: bool = True,
    digits: int = 9,
    piece: int = PIECE,
) -> DataFrame:
    """(id, neighbour, distance, place): k near corpus rows of every query, nearest first.

    ``rows`` is what `index_rows` made of the corpus; ``keep`` rows a query (8 k
    unless given) are compared exactly. Distances are rounded to ``digits``, equal
    ones placed by id.
    """
    keep = keep or 8 * k
    kind = corpus.schema["id"].dataType.simpleString()
    asker = queries.schema["id"].dataType.simpleString()

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cells = index.cells(_matrix(pdf["vec"]), index.probes)
                out = pdf.iloc[np.repeat(np.arange(len(pdf)), cells.shape[1])].reset_index(drop=True)
                yield out.assign(cell=cells.ravel().astype(np.int32))

    asked = queries.select("id", "vec").mapInPandas(probed, f"id {asker}, vec array<double>, cell int")
    # At most a row a cell: how many pieces its rows and its queries are cut into.
    count = F.count(F.lit(1))
    held = {r.cell: r.n for r in rows.groupBy("cell").agg(count.alias("n")).collect()}
    wanted = {r.cell: r.n for r in asked.groupBy("cell").agg(count.alias("n")).collect()}
    both = [(c, math.ceil(n / piece), math.ceil(wanted[c] / piece)) for c, n in held.items() if c in wanted]
    plan = queries.sparkSession.createDataFrame(both, "cell int, cn int, qn int")
    left = asked.join(plan, "cell").select(
        "cell",
        F.pmod(F.xxhash64("id"), "qn").cast("int").alias("qp"),
        F.explode(F.sequence(F.lit(0), F.col("cn") - 1)).alias("cp"),
        "id",
        "vec",
    )
    right = rows.join(plan, "cell").select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qp"),
        F.pmod(F.xxhash64("id"), "cn").cast("int").alias("cp"),
        "id",
        "code",
    )

    def roughly(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"id": q["id"][:0], "neighbour": c["id"][:0], "rough": np.zeros(0, np.float32)})
        codes = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
        ids, mine = c["id"].to_numpy(), q["id"].to_numpy()
        # Blocks of queries, so that a task holds no large table of distances.
        found = []
        for at in range(0, len(q), 256):
            own = mine[at : at + 256]
            d = index.rough(_matrix(q["vec"][at : at + 256]), int(key[0]), codes)
            if exclude_self:
                d[own[:, None] == ids[None]] = np.inf
            few = min(keep, len(c))
            best = np.argpartition(d, few - 1, axis=1)[:, :few]
            near = np.take_along_axis(d, best, 1).ravel()
            table = pd.DataFrame({"id": np.repeat(own, few), "neighbour": ids[best.ravel()], "rough": near})
            found.append(table[np.isfinite(near)])
        return pd.concat(found)

    keys = ["cell", "qp", "cp"]
    seen = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(roughly, f"id {asker}, neighbour {kind}, rough float")
    )
    order = Window.partitionBy("id").orderBy("rough", "neighbour")
    kept = seen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
    here = queries.select("id", F.col("vec").cast("array<double>").alias("_here"))
    there = corpus.select(F.col("id").alias("neighbour"), F.col("vec").cast("array<double>").alias("_there"))
    # The query's vector joins where its candidates already are; one exchange brings both to the neighbour.
    pairs = kept.select("id", "neighbour").join(here, "id").join(there, "neighbour")
    square = F.aggregate(F.zip_with("_here", "_there", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.select("id", "neighbour", F.round(F.sqrt(square), digits).alias("distance"))
    nearest = Window.partitionBy("id").orderBy("distance", "neighbour")
    return exact.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours that `exact` has, and the share of them in ``found``."""
    hit = found.select("id", "neighbour", F.lit(1.0).alias("_hit"))
    joined = exact.select("id", "neighbour").join(hit, ["id", "neighbour"], "left")
    return joined.agg(F.count(F.lit(1)).alias("neighbours"), F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
