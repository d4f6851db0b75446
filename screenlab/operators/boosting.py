"""Gradient-boosted trees with a chosen loss, grown from grouped histograms.

Features become numbers of bins once.  For each level of a tree every task sums
the gradients of its rows by (node, feature, bin); these sums are grouped over
all tasks, and running sums within a feature give the gain of every cut.  Only
the best cut of each node comes to the driver.  Rows of a watched fold take no
part in the sums; their loss, taken in the same pass, ends the boosting.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlab.session import cut_lineage

Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _squared(margin: np.ndarray, y: np.ndarray):
    z = margin - y
    return z, np.ones_like(z), z * z


def _pseudo_huber(margin: np.ndarray, y: np.ndarray):
    z = margin - y
    root = np.sqrt(1 + z * z)
    return z / root, 1 / root**3, root - 1


def _logistic(margin: np.ndarray, y: np.ndarray):
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16), np.logaddexp(0, margin) - y * margin


#: Gradient, curvature and loss of each row, by name of the loss.
LOSSES: dict[str, Loss] = {"squared": _squared, "pseudo_huber": _pseudo_huber, "logistic": _logistic}

#: Trees after which rows are written with the margins so far.
KEPT = 10


@dataclass(frozen=True)
class Settings:
    loss: str = "squared"
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    penalty: float = 1.0  # on squared leaf values
    threshold: float = 0.0  # on absolute leaf values
    least: float = 1.0  # curvature in a leaf
    row_share: float = 1.0  # share of the rows a tree sees
    column_share: float = 1.0  # share of the features a tree sees
    patience: int | None = None
    seed: int = 0


@dataclass
class Tree:
    """Nodes by number: those below node n are 2n+1 and 2n+2. A leaf has feature -1."""

    feature: dict[int, int] = field(default_factory=dict)
    cut: dict[int, int] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node of each row so far."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.feature):
            here = np.flatnonzero(at == node)
            right = bins[here, self.feature[node]] > self.cut[node]
            at[here] = 2 * node + 1 + right
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        leaves = np.array(sorted(self.value), np.int64)
        values = np.array([self.value[k] for k in leaves])
        return values[np.searchsorted(leaves, at)]


@dataclass
class Boosted:
    """A fitted model: cuts between bins, trees, and the margin before the first one."""

    settings: Settings
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    watched: list[float]

    def bins(self, features: np.ndarray) -> np.ndarray:
        """A row a vector: bin b holds the values after edge b-1, up to and with edge b."""
        return np.stack(
            [np.searchsorted(e, features[:, k], "left").astype(np.uint8) for k, e in enumerate(self.edges)], 1
        )

    def margins(self, features: np.ndarray) -> np.ndarray:
        bins = self.bins(features)
        return self.base + sum((t.margins(bins) for t in self.trees), np.zeros(len(bins)))

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction``: a probability under logistic loss, else the value."""
        logistic = self.settings.loss == "logistic"

        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                m = self.margins(np.stack(rows.to_list())) if len(rows) else np.zeros(0)
                yield pd.Series(1 / (1 + np.exp(-m)) if logistic else m, dtype=float)

        return df.withColumn("prediction", F.pandas_udf(scored, "double")(vector_to_array("features")))

    def text(self) -> str:
        """The model as one line of JSON."""
        return json.dumps({**asdict(self), "trees": [[list(d.items()) for d in (t.feature, t.cut, t.value)] for t in self.trees]})

    @classmethod
    def read(cls, text: str) -> Boosted:
        told = json.loads(text)
        trees = [Tree(*[{int(k): v for k, v in d} for d in t]) for t in told["trees"]]
        return cls(Settings(**told["settings"]), told["edges"], told["base"], trees, told["watched"])


def bin_edges(df: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Cuts between at most ``bins`` bins of each feature, at quantiles of the rows."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    values = vector_to_array("features")
    row = df.select(*[F.get(values, F.lit(k)).alias(f"f{k}") for k in range(width)]).agg(
        *[F.percentile_approx(f"f{k}", shares, 10_000).alias(f"f{k}") for k in range(width)]
    )
    return [sorted(set(x or [])) for x in row.first()]


def best_cuts(sums: DataFrame, settings: Settings) -> DataFrame:
    """(node, g, h, feature, cut, gain) of sums (node, feature, bin, g, h), one row a node.

    Of equal gains the lowest feature and the lowest cut count; a node without an
    allowed cut has no feature.
    """
    t, p = settings.threshold, settings.penalty

    def worth(g: Column, h: Column) -> Column:
        pulled = F.signum(g) * F.greatest(F.abs(g) - t, F.lit(0.0))
        return pulled * pulled / (h + p)

    of = Window.partitionBy("node", "feature")
    up = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select(
        "node",
        "feature",
        "bin",
        F.sum("g").over(up).alias("lg"),
        F.sum("h").over(up).alias("lh"),
        F.sum("g").over(of).alias("g"),
        F.sum("h").over(of).alias("h"),
    )
    rg, rh = F.col("g") - F.col("lg"), F.col("h") - F.col("lh")
    # Equal cuts of different features differ by rounding only: compared at twelve digits of the gain.
    gain = worth(F.col("lg"), F.col("lh")) + worth(rg, rh) - worth(F.col("g"), F.col("h"))
    digits = F.format_string("%.11e", gain).cast("double")
    fine = (F.col("lh") >= settings.least) & (rh >= settings.least) & (gain > 1e-9)
    best = F.max(F.when(fine, F.struct(digits.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))))
    found = run.groupBy("node").agg(F.min_by("g", "feature").alias("g"), F.min_by("h", "feature").alias("h"), best.alias("x"))
    return found.select("node", "g", "h", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("cut"), F.col("x.gain"))


def _leaf(g: float, h: float, s: Settings) -> float:
    return -s.rate * np.sign(g) * max(abs(g) - s.threshold, 0.0) / (h + s.penalty)


def fit_boosted(
    train: DataFrame,
    settings: Settings,
    key: Sequence[str] = (),
    bins: int = 64,
    watch: str | None = None,
    edges: list[list[float]] | None = None,
) -> Boosted:
    """A model of ``label`` by ``features`` with row ``weight`` (1 where that column is missing).

    Rows of a boolean column ``watch`` only tell when to stop: after ``patience``
    trees that don't lower their mean loss, the trees up to the lowest are kept.
    ``key`` columns draw the rows of a tree when it sees a share of them.
    """
    loss = LOSSES[settings.loss]
    train = train if "weight" in train.columns else train.withColumn("weight", F.lit(1.0))
    width = len(train.select(vector_to_array("features")).first()[0])
    watched = F.coalesce(F.col(watch), F.lit(False)) if watch else F.lit(False)
    fitted = train.where(~watched)
    model = Boosted(settings, edges or bin_edges(fitted, width, bins), 0.0, [], [])
    if max(map(len, model.edges)) > 255:
        raise ValueError("at most 256 bins")
    label, weight = F.col("label").cast("double"), F.col("weight").cast("double")
    mean = fitted.agg((F.sum(label * weight) / F.sum(weight)).alias("m")).first().m
    if mean is None:
        raise ValueError("no rows to fit")
    if settings.loss == "logistic":
        if not 0 < mean < 1:
            raise ValueError("both labels must occur")
        mean = float(np.log(mean / (1 - mean)))
    model.base = float(mean)
    size = max(map(len, model.edges)) + 1
    draw = F.xxhash64(*[F.col(k) for k in key]) if key else F.xxhash64(vector_to_array("features"), label)
    rows = train.select(
        vector_to_array("features").alias("x"), label.alias("y"), weight.alias("w"), watched.alias("v"), draw.alias("k")
    )

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = model.bins(np.stack(pdf["x"].to_list()))
                yield pdf.drop(columns="x").assign(b=[x.tobytes() for x in b], m=model.base)

    schema = "y double, w double, v boolean, k long, b binary, m double"
    rows = cut_lineage(rows.mapInPandas(binned, schema))
    done = 0  # trees that the rows' margins hold already
    best, lowest = 0, np.inf

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(pdf), width)

    def with_margins(trees: list[Tree]):
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    b = matrix(pdf)
                    yield pdf.assign(m=pdf["m"] + sum(t.margins(b) for t in trees))

        return add

    def summed(trees: list[Tree], tree: Tree, level: int, columns: list[int], drawn: int):
        """Sums of a level; at the root also the watched rows' loss, as node -1."""
        nodes = list(range((1 << level) - 1, (2 << level) - 1))
        limit = settings.row_share * 2.0**32

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, len(nodes) * len(columns) * size))
            seen = np.zeros(2)
            for pdf in batches:
                if not len(pdf):
                    continue
                b = matrix(pdf)
                m = pdf["m"].to_numpy() + sum((t.margins(b) for t in trees), np.zeros(len(b)))
                y, w, v = (pdf[c].to_numpy() for c in "ywv")
                g, h, told = loss(m, y)
                if level == 0:
                    seen += (told[v] @ w[v], w[v].sum())
                mixed = (pdf["k"].to_numpy().astype(np.uint64) + np.uint64(drawn)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                at = tree.nodes(b)
                use = ~v & ((mixed >> np.uint64(32)).astype(np.float64) < limit) & (at >= nodes[0])
                slot = ((at[use] - nodes[0])[:, None] * len(columns) + np.arange(len(columns))) * size + b[use][:, columns]
                for k, x in enumerate((g, h)):
                    each = np.repeat((x * w)[use], len(columns))
                    total[k] += np.bincount(slot.ravel(), each, minlength=total.shape[1])
            full = np.flatnonzero(total[1])
            node, rest = np.divmod(full, len(columns) * size)
            column, place = np.divmod(rest, size)
            yield pd.DataFrame(
                {
                    "node": np.r_[node + nodes[0], -1],
                    "feature": np.r_[np.array(columns, np.int64)[column], 0],
                    "bin": np.r_[place, 0],
                    "g": np.r_[total[0, full], seen[0]],
                    "h": np.r_[total[1, full], seen[1]],
                }
            )

        return add

    rng = np.random.default_rng(settings.seed)
    for n in range(settings.rounds + bool(watch)):
        if n - done >= KEPT:
            rows, done = cut_lineage(rows.mapInPandas(with_margins(model.trees[done:]), schema)), n
        columns = sorted(rng.permutation(width)[: max(1, round(settings.column_share * width))].tolist())
        drawn = int(rng.integers(1 << 62))
        tree = Tree()
        for level in range(settings.depth + 1):
            sums = rows.mapInPandas(
                summed(model.trees[done:], tree, level, columns, drawn),
                "node long, feature long, bin long, g double, h double",
            )
            sums = sums.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            cuts = best_cuts(sums, settings).collect()  # a row a node
            if level == 0 and watch:
                told = next(c for c in cuts if c.node == -1)
                model.watched.append(told.g / told.h if told.h else float("nan"))
                if model.watched[-1] < lowest:
                    best, lowest = n, model.watched[-1]
            if n == settings.rounds or (settings.patience and n - best >= settings.patience):
                break
            split = False
            for c in cuts:
                if c.node < 0:
                    continue
                if c.feature is None or level == settings.depth:
                    tree.value[c.node] = float(_leaf(c.g, c.h, settings))
                else:
                    tree.feature[c.node], tree.cut[c.node] = c.feature, c.cut
                    split = True
            if not split:
                break
        if not tree.value:
            break
        # A child that no drawn row falls into.
        for node in tree.feature:
            for child in (2 * node + 1, 2 * node + 2):
                if child not in tree.feature:
                    tree.value.setdefault(child, 0.0)
        model.trees.append(tree)
    if watch and settings.patience:
        model.trees = model.trees[:best]
    return model


@dataclass
class Boosting:
    """`fit_boosted` with its settings, in the form of an estimator."""

    settings: Settings
    key: Sequence[str] = ()
    bins: int = 64
    watch: str | None = None

    def fit(self, train: DataFrame) -> Boosted:
        return fit_boosted(train, self.settings, self.key, self.bins, self.watch)
