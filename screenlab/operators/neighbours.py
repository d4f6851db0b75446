"""Exact k nearest neighbours without moving each row to every other.

The corpus is cut into cells around a few pivot vectors.  From the cells' sizes
and radii each query gets a distance within which its k neighbours must lie, and
by the triangle inequality only the cells that reach into that distance are
searched.  Neighbouring small cells share a bundle.  The rows of a bundle are packed
into blocks of bounded size, one row of bytes each, and written once; blocks of
queries meet blocks of the corpus in a cartesian product, which reads these files
again and shuffles no vector.  A task keeps the k best of a block of queries over
all blocks of its part of the corpus, so what is shuffled is k rows a query and part.
Inside a task some distances are held at once, whatever ties and copies there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlab.operators.ordered import row_numbers
from screenlab.session import cut_lineage

PIVOTS = 64
#: Rows of a block at most on average.
PIECE = 4096
#: Blocks of a part of the corpus, or of the queries; a task meets one part of each.
HEAPED = 16
#: Distances that a task holds at once.
HELD = 1 << 21


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise Euclidean distances to about 1e-7 of the vectors' size."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _pivots(corpus: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` distinct corpus vectors, the first in hash order of their id."""
    rows = (
        corpus.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
    )
    return np.unique(np.array([r.vec for r in rows], dtype=np.float64), axis=0)


def _assigned(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``reach`` (distance to it)."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), pivots)
                at = d.argmin(1)
                yield pdf.assign(cell=at.astype("int32"), reach=d[np.arange(len(at)), at])

    return df.mapInPandas(assign, f"{_ddl(df)}, cell int, reach double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _bundles(points: np.ndarray, sizes: np.ndarray, piece: int) -> np.ndarray:
    """The number of each cell's bundle: cells in a walk from each to the nearest left, up to ``piece`` rows together."""
    apart, at = _distances(points, points), 0
    left, out = np.ones(len(points), bool), np.zeros(len(points), np.int32)
    number = held = 0
    for _ in points:
        left[at] = False
        if held and held + sizes[at] > piece:
            number, held = number + 1, 0
        out[at], held = number, held + sizes[at]
        at = int(np.where(left, apart[at], np.inf).argmin())
    return out


def _packed(
    rows: DataFrame, points: np.ndarray, cells: np.ndarray, sizes: np.ndarray, radii: np.ndarray, need: int, piece: int, slack: float
) -> DataFrame:
    """(block, bundle, wanted, n, ids, vecs, within): rows(id, vec) as blocks of about ``piece`` rows of a bundle, written.

    ``within`` has a distance for each row that holds ``need`` corpus rows, ``wanted`` the
    bundles that any of the rows has to be compared with.
    """
    bundle = _bundles(points[cells], sizes, piece)
    of = np.zeros(len(points), np.int32)
    of[cells] = bundle

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(bundle=of[_distances(_matrix(pdf["vec"]), points).argmin(1)])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _matrix(pdf["vec"])
        within, wanted = np.empty(len(x)), np.zeros(int(bundle.max()) + 1, bool)
        for at in range(0, len(x), 256):
            to = _distances(x[at : at + 256], points)[:, cells]
            far = to + radii
            order = np.argsort(far, axis=1)
            enough = np.cumsum(sizes[order], axis=1) >= need
            last = np.where(enough.any(1), enough.argmax(1), len(cells) - 1)
            within[at : at + 256] = np.take_along_axis(far, order, 1)[np.arange(len(to)), last] + slack
            wanted[bundle[(to - radii <= within[at : at + 256, None]).any(0)]] = True
        return pd.DataFrame(
            {
                "block": [f"{pdf['bundle'].iloc[0]}.{pdf['part'].iloc[0]}"],
                "bundle": pdf["bundle"].iloc[:1].to_numpy(),
                "wanted": [np.flatnonzero(wanted).astype(np.int32)],
                "n": [len(x)],
                "ids": [pdf["id"].to_numpy(np.int64).tobytes()],
                "vecs": [x.tobytes()],
                "within": [within.tobytes()],
            }
        )

    located = rows.mapInPandas(placed, f"{_ddl(rows)}, bundle int")
    held = {r.bundle: r.n for r in located.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(b, max(1, math.ceil(n / piece))) for b, n in held.items()]
    total = sum(n for _, n in blocks)
    # Fewer blocks still give each core some pairs of parts.
    few = math.ceil(math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))
    parts = max(1, math.ceil(total / HEAPED), min(total, few))
    plan = F.create_map(*[F.lit(x) for pair in blocks or [(0, 1)] for x in pair])
    part = F.pmod(F.xxhash64("id"), plan[F.col("bundle")])
    out = located.withColumn("part", part.cast("int")).repartition(parts, "bundle", "part").groupBy("bundle", "part")
    kinds = "block string, bundle int, wanted array<int>, n int, ids binary, vecs binary, within binary"
    return cut_lineage(out.applyInPandas(pack, kinds))


class _Best:
    """The k best of the rows of a block so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, within: np.ndarray, k: int, exclude_self: bool, digits: int, slack: float) -> None:
        self.ids, self.x, self.limit = ids, x, within.copy()
        self.k, self.other, self.digits, self.slack = k, exclude_self, digits, slack
        self.distance = np.full((len(x), k), np.inf)
        self.neighbour = np.full((len(x), k), np.iinfo(np.int64).max)

    def meet(self, mine: np.ndarray, ids: np.ndarray, y: np.ndarray, middle: np.ndarray) -> None:
        """Compare the rows ``mine`` with the rows of a block."""
        a, b = self.x[mine] - middle, y - middle
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        largest = max(aa.max(), bb.max())
        # In single precision to a known error; what may be near is compared again in double.
        kind = np.float32 if largest < 1e30 else np.float64
        error = 4 * (a.shape[1] + 8) * float(np.finfo(kind).eps) * largest
        a = np.column_stack([-2 * a, aa, np.ones(len(a))]).astype(kind)
        b = np.column_stack([b, np.ones(len(b)), bb]).astype(kind)
        need = self.k + self.other
        block = max(1, HELD // len(b))
        for at in range(0, len(a), block):
            here = mine[at : at + block]
            rough = a[at : at + block] @ b.T
            limit = self.limit[here]
            if len(b) >= need and not np.isfinite(self.distance[here, -1]).all():
                some = rough[:, : max(512, 8 * need)]
                nth = np.partition(some, need - 1, axis=1)[:, need - 1].astype(np.float64)
                limit = np.minimum(limit, np.sqrt(np.maximum(nth + error, 0.0)) + self.slack)
            most = (limit * limit + error).astype(kind) * (1 + np.finfo(kind).eps)
            rows, cols = np.divmod(np.flatnonzero(rough <= most[:, None]), len(b))
            # Many copies may be within the limit; their vectors are laid side by side in parts.
            square = np.empty(len(rows))
            step = max(1, HELD // y.shape[1])
            for i in range(0, len(rows), step):
                square[i : i + step] = ((self.x[here[rows[i : i + step]]] - y[cols[i : i + step]]) ** 2).sum(1)
            exact = np.round(np.sqrt(square), self.digits)
            rows, to = here[rows], ids[cols]
            if self.other:
                keep = self.ids[rows] != to
                rows, to, exact = rows[keep], to[keep], exact[keep]
            self._add(rows, to, exact)

    def _add(self, rows: np.ndarray, to: np.ndarray, exact: np.ndarray) -> None:
        touched = np.unique(rows)
        rows = np.concatenate([np.repeat(touched, self.k), rows])
        to = np.concatenate([self.neighbour[touched].ravel(), to])
        exact = np.concatenate([self.distance[touched].ravel(), exact])
        # by query, distance and id
        order = np.lexsort((to, exact, rows))
        rows, to, exact = rows[order], to[order], exact[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = nth < self.k
        self.distance[rows[best], nth[best]], self.neighbour[rows[best], nth[best]] = exact[best], to[best]
        self.limit[touched] = np.minimum(self.limit[touched], self.distance[touched, -1] + self.slack)

    def batch(self) -> pa.RecordBatch:
        found = np.isfinite(self.distance)
        ids = np.repeat(self.ids, self.k).reshape(found.shape)
        return pa.record_batch([ids[found], self.neighbour[found], self.distance[found]], ["id", "neighbour", "distance"])


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    exclude_self: bool = True,
    pivots: int = PIVOTS,
    piece: int = PIECE,
    digits: int = 9,
) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest corpus rows of every query.

    queries(id, vec) and corpus(id, vec).  Distances are rounded to ``digits``;
    equal ones are placed by id.
    """
    same = queries is corpus
    queries, corpus = queries.select("id", "vec"), corpus.select("id", "vec")
    points = _pivots(corpus, pivots)
    if len(points) == 0:
        raise ValueError("an empty corpus has no neighbours")
    stats = (
        _assigned(corpus, points).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"))
    ).collect()  # at most one row per pivot
    cells = np.array([s.cell for s in stats], dtype=np.int64)
    sizes = np.array([s.n for s in stats], dtype=np.int64)
    radii = np.array([s.radius for s in stats], dtype=np.float64)
    bundle = _bundles(points[cells], sizes, piece)
    # room for the rounding of the distances to pivots
    slack = 1e-6 * (1.0 + float(np.abs(points).max()) * math.sqrt(points.shape[1]))
    right = _packed(corpus, points, cells, sizes, radii, k + exclude_self, piece, slack)
    left = right if same else _packed(queries, points, cells, sizes, radii, k + exclude_self, piece, slack)
    right = right.select(F.col("bundle").alias("r_bundle"), F.col("ids").alias("r_ids"), F.col("vecs").alias("r_vecs"))
    pairs = left.drop("bundle").join(right.hint("shuffle_replicate_nl"), F.array_contains("wanted", F.col("r_bundle")))
    width, middle = points.shape[1], points.mean(0)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                this = {c: batch.column(c)[row] for c in batch.schema.names}
                if this["block"].as_py() != name:
                    if best is not None:
                        yield best.batch()
                    name = this["block"].as_py()
                    x = np.frombuffer(this["vecs"].as_buffer()).reshape(-1, width).copy()
                    ids = np.frombuffer(this["ids"].as_buffer(), np.int64).copy()
                    best = _Best(ids, x, np.frombuffer(this["within"].as_buffer()), k, exclude_self, digits, slack)
                    to = _distances(x, points)[:, cells] - radii
                y = np.frombuffer(this["r_vecs"].as_buffer()).reshape(-1, width)
                near = to[:, bundle == this["r_bundle"].as_py()] <= best.limit[:, None] + slack
                mine = np.flatnonzero(near.any(1))
                if len(mine):
                    best.meet(mine, np.frombuffer(this["r_ids"].as_buffer(), np.int64), y, middle)
        if best is not None:
            yield best.batch()

    found = pairs.mapInArrow(search, "id long, neighbour long, distance double")
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def label_purity(near: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each row's neighbours with its own label; labels(id, label)."""
    own = labels.select("id", "label")
    other = labels.select(F.col("id").alias("neighbour"), F.col("label").alias("_other"))
    joined = near.join(own, "id").join(other, "neighbour")
    return joined.groupBy("id", "label").agg(
        F.avg((F.col("_other") == F.col("label")).cast("double")).alias("purity")
    )


def purity_by_label(purity: DataFrame) -> DataFrame:
    return purity.groupBy("label").agg(
        F.avg("purity").alias("mean"), F.count(F.lit(1)).alias("rows")
    )


def knn_vote(near: DataFrame, labels: DataFrame) -> DataFrame:
    """Positive probability by inverse-distance vote; exact matches take all the weight."""
    other = labels.select(F.col("id").alias("neighbour"), F.col("y").cast("double").alias("y"))
    joined = near.join(other, "neighbour")
    zero = F.col("distance") == 0
    w = F.try_divide(F.lit(1.0), F.col("distance"))
    exact = F.avg(F.when(zero, F.col("y")))
    return joined.groupBy("id").agg(
        F.coalesce(exact, F.try_divide(F.sum(w * F.col("y")), F.sum(w))).alias("probability")
    )


def synthetic(df: DataFrame, k: int = 5, seed: int = 0, ratio: float = 1.0) -> DataFrame:
    """(id, neighbour, t, vec): new positives until there are ratio x negatives.

    df(id, vec, y). Each lies at share ``t`` of the way from a positive to one of its
    k nearest positives; no positive has two more of them than another. With fewer
    than two positives, or enough of them, there are none.
    """
    minority = df.where(F.col("y") == 1)
    counts = df.agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    ).first()
    missing, pos = math.floor(ratio * counts.neg) - counts.pos, counts.pos
    if missing <= 0 or pos < 2:
        empty = df.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("t"), "vec").where(F.lit(False))
        return empty.withColumn("vec", F.col("vec").cast("array<double>"))
    near = knn(minority, minority, min(k, pos - 1))
    width = min(k, pos - 1)
    base, extra = divmod(missing, pos)
    placed = row_numbers(
        minority.select("id", "vec", F.xxhash64("id", F.lit(seed)).alias("_h")), [], "_h", "_rn"
    )
    copies = F.lit(base) + F.when(F.col("_rn") <= extra, 1).otherwise(0)
    made = (
        placed.withColumn("_copies", copies.cast("int"))
        .where(F.col("_copies") > 0)
        .select("id", "vec", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    )
    made = made.select(
        "id",
        "vec",
        (F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.lit(width)) + 1).cast("int").alias("place"),
        (F.pmod(F.xxhash64("copy", "id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)).alias("t"),
    )
    partner = minority.select(F.col("id").alias("neighbour"), F.col("vec").alias("_to"))
    step = F.zip_with("vec", "_to", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    point = F.transform(step, lambda s: s["a"] + (s["b"] - s["a"]) * F.col("t"))
    return (
        made.join(near.select("id", "place", "neighbour"), ["id", "place"])
        .join(partner, "neighbour")
        .select("id", "neighbour", "t", point.cast("array<double>").alias("vec"))
    )


def smote(df: DataFrame, k: int = 5, seed: int = 0, ratio: float = 1.0) -> DataFrame:
    """(vec, y): the rows of df(id, vec, y) and synthetic positives up to ratio x negatives."""
    real = df.select(F.col("vec").cast("array<double>").alias("vec"), "y")
    return real.unionByName(synthetic(df, k, seed, ratio).select("vec", F.lit(1).alias("y")))


def _keyed(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a number of their own, written so that it stays, and (id, vec, y) of them."""
    rows = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
    return rows, rows.select(F.col("_id").alias("id"), vector_to_array("features").alias("vec"), F.col(label).alias("y"))


def smote_rows(df: DataFrame, label: str, order: str = "", ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """The design rows and synthetic positives, which have the other columns of the row they start from."""
    rows, points = _keyed(df, label)
    new = synthetic(points, seed=seed, ratio=ratio).select(F.col("id").alias("_id"), array_to_vector("vec").alias("features"))
    new = rows.drop("features").join(new, "_id").select(*df.columns)
    return rows.select(*df.columns).union(new)


def smote_tomek_rows(df: DataFrame, label: str, order: str = "", ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """`smote_rows` without both ends of every Tomek link there is then."""
    rows, points = _keyed(smote_rows(df, label, order, ratio, seed), label)
    return rows.join(tomek_links(points).withColumnRenamed("id", "_id"), "_id", "left_anti").select(*df.columns)


def tomek_links(df: DataFrame) -> DataFrame:
    """Ids of rows that are each other's nearest neighbour and differ in y; df(id, vec, y)."""
    one = knn(df, df, 1).select("id", "neighbour")
    back = one.select(F.col("id").alias("neighbour"), F.col("neighbour").alias("_back"))
    y = df.select("id", "y")
    other = df.select(F.col("id").alias("neighbour"), F.col("y").alias("_y"))
    mutual = one.join(back, "neighbour").where(F.col("_back") == F.col("id"))
    return mutual.join(y, "id").join(other, "neighbour").where(F.col("y") != F.col("_y")).select("id")


def without_tomek_links(df: DataFrame) -> DataFrame:
    return df.join(tomek_links(df), "id", "left_anti")
