"""Many decision trees grown at once: every level of all of them is one pass over the rows.

A nested search fits a tree for each setting, inner fold and outer fold.  Here a
task counts its rows by (tree, node, feature, bin, label) for all trees together,
trees that are still alike sharing their counts.  The counts of a node are added
up in a group, where the best cut is chosen under each tree's own limit; the
driver gets one row a node.  Trees of less depth are the tops of deeper ones, so
depth takes no fits of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.operators.boosting import Tree
from screenlab.session import written


class Fit(NamedTuple):
    """A tree for the rows of ``outer`` whose fold is neither that nor ``inner``, no child under ``least`` rows."""

    outer: str
    inner: str | None
    least: int


@dataclass
class Grown(Tree):
    """A tree with the counts (negatives, positives) of every node, and the weight of a positive."""

    counts: dict[int, tuple[int, int]] = field(default_factory=dict)
    positive: float = 1.0

    def shares(self, depth: int) -> dict[int, tuple[int, float]]:
        """For each node: its ancestor no deeper than ``depth``, and the weighted share of positives there."""
        out = {}
        for node in self.counts:
            at = node
            while (at + 1).bit_length() - 1 > depth:
                at = (at - 1) // 2
            a, b = self.counts[at]
            out[node] = (at, self.positive * b / (a + self.positive * b) if a + b else 0.0)
        return out


def best_cut(hist: np.ndarray, least: int, positive: float) -> tuple[int, int] | None:
    """(feature, bin) with the largest drop of weighted Gini impurity; of equal ones the first."""
    left = hist.cumsum(axis=2)[:, :, :-1].astype(float)
    right = hist.sum(axis=2, keepdims=True) - left

    def impure(x: np.ndarray) -> np.ndarray:
        a, b = x[0], positive * x[1]
        return np.where(a + b > 0, 2 * a * b / np.maximum(a + b, 1e-300), 0.0)

    whole = hist.sum(axis=2)[:, :1].astype(float)
    gain = impure(whole)[0] - impure(left) - impure(right)
    fine = (left.sum(0) >= least) & (right.sum(0) >= least)
    gain = np.where(fine, gain, -1.0).round(9)
    if gain.size == 0 or gain.max() <= 0:
        return None
    return tuple(int(x) for x in np.unravel_index(gain.argmax(), gain.shape))


def _values(design: DataFrame) -> Column:
    """The features as an array, whether they are one or a vector."""
    return F.col("features") if dict(design.dtypes)["features"].startswith("array") else vector_to_array("features")


def outer_edges(design: DataFrame, outer: str, fold: str, folds: Sequence[str], width: int, bins: int) -> dict[str, list[list[float]]]:
    """`bin_edges` of the training rows of every outer fold, in one pass."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    rows = design.where(F.col(outer).isin(*folds) & ~F.col(fold).eqNullSafe(F.col(outer)))
    rows = rows.select(F.col(outer).cast("string").alias("_o"), _values(design).alias("_x"))
    cuts = [F.percentile_approx(F.get("_x", F.lit(k)), shares, 10_000).alias(f"f{k}") for k in range(width)]
    found = {r["_o"]: [sorted(set(r[f"f{k}"] or [])) for k in range(width)] for r in rows.groupBy("_o").agg(*cuts).collect()}
    return {o: found.get(o, [[] for _ in range(width)]) for o in folds}


def binned(design: DataFrame, outer: str, fold: str, edges: dict[str, list[list[float]]], keep: Sequence[str]) -> DataFrame:
    """Rows with one byte a feature, by the edges of their outer fold; written, as every level reads them.

    Many rows of an outer fold and a fold are packed into one: the labels, a byte each, and
    the bins, feature by feature. Rows held out have their ``keep`` columns as arrays, which
    no other rows need.
    """
    names = [f"`{c}` array<{design.schema[c].dataType.simpleString()}>" for c in keep]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(np.uint8)
            pairs = pd.MultiIndex.from_arrays([batch.column(c).to_pandas().astype(str) for c in ("_o", "_f")])
            codes, kinds = pd.factorize(pairs)
            kept: dict[str, list] = {c: [] for c in keep}
            out: list[tuple[str, str, bytes, bytes]] = []
            for code, (o, f) in enumerate(kinds):
                at = np.flatnonzero(codes == code)
                b = np.stack([np.searchsorted(e, x[at, k], "left").astype(np.uint8) for k, e in enumerate(edges[o])])
                out.append((o, f, y[at].tobytes(), b.tobytes()))
                for c in keep:
                    kept[c].append(batch.column(c).take(pa.array(at)).to_pylist() if o == f else None)
            arrays = [pa.array(kept[c], pa.list_(batch.column(c).type)) for c in keep]
            for part, kind in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True):
                arrays.append(pa.array(part, kind))
            yield pa.record_batch(arrays, [*keep, "_o", "_f", "_y", "_b"])

    rows = design.select(
        *keep,
        F.col(outer).cast("string").alias("_o"),
        F.col(fold).cast("string").alias("_f"),
        F.col("label").cast("int").alias("_y"),
        _values(design).alias("_x"),
    )
    return written(rows.mapInArrow(coded, ", ".join([*names, "_o string", "_f string", "_y binary", "_b binary"])))


#: Rows whose bins are looked at together.
TOGETHER = 1 << 16


def _bins(packed: bytes, rows: int) -> np.ndarray:
    """The bins of a packed row, a row a vector."""
    return np.frombuffer(packed, np.uint8).reshape(-1, rows).T


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """(outer, fold, bins, labels) of the packed rows of a batch, many rows at once."""
    for (o, f), part in pdf.groupby(["_o", "_f"]):
        ends = part["_y"].str.len().cumsum() // TOGETHER
        for _, some in part.groupby(ends):
            bins = np.concatenate([_bins(b, len(y)) for b, y in zip(some["_b"], some["_y"], strict=True)])
            yield o, f, bins, np.frombuffer(b"".join(some["_y"]), np.uint8).astype(np.int64)


def grow(rows: DataFrame, fits: Sequence[Fit], depth: int, width: int, size: int) -> dict[Fit, Grown]:
    """The tree of each fit, down to ``depth``, from `binned` rows of ``width`` features and ``size`` bins."""
    trees = {f: Grown() for f in fits}
    for level in range(depth + 1):
        first = (1 << level) - 1
        # Trees of the same rows and the same cuts so far have the same counts.
        alike: dict[tuple, list[Fit]] = defaultdict(list)
        for f, t in trees.items():
            if level == 0 or any(n >= (first - 1) // 2 for n in t.feature):
                alike[(f.outer, f.inner, *sorted((n, k, t.cut[n]) for n, k in t.feature.items()))].append(f)
        shared = [same for _, same in sorted(alike.items(), key=lambda x: str(x[0]))]
        if not shared:
            break
        heads = defaultdict(list)
        for k, same in enumerate(shared):
            heads[same[0].outer].append((k, same[0].inner, trees[same[0]]))

        def counted(batches: Iterator[pd.DataFrame], heads=dict(heads), first=first, n=len(shared)) -> Iterator[pd.DataFrame]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                for o, fold, bins, y in _parts(pdf):
                    for k, inner, tree in heads.get(o, ()) if fold != o else ():
                        if fold == str(inner):
                            continue
                        at = tree.nodes(bins)
                        here = at >= first
                        nodes, nth = np.unique(at[here], return_inverse=True)
                        slot = ((2 * nth + y[here])[:, None] * width + np.arange(width)) * size + bins[here]
                        hists = np.bincount(slot.ravel(), minlength=len(nodes) * 2 * width * size)
                        for node, hist in zip(nodes.tolist(), hists.reshape(len(nodes), 2 * width * size), strict=True):
                            total[k, node] = total.get((k, node), 0) + hist
            yield pd.DataFrame(
                {"k": [k for k, _ in total], "node": [x for _, x in total], "h": [h.tobytes() for h in total.values()]}
            )

        def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
            hist = sum(np.frombuffer(h, np.int64) for h in pdf["h"]).reshape(2, width, size)
            negatives, positives = (int(x) for x in hist[:, 0].sum(axis=1))
            k, node = int(pdf["k"].iloc[0]), int(pdf["node"].iloc[0])
            out = []
            for i, f in enumerate(shared[k]):
                weight = trees[f].positive if level else (negatives / positives if positives else 1.0)
                cut = best_cut(hist, f.least, weight) if level < depth else None
                out.append((k, i, node, *(cut or (-1, -1)), negatives, positives, weight))
            return pd.DataFrame(out, columns=["k", "i", "node", "feature", "cut", "a", "b", "weight"])

        sums = rows.select("_o", "_f", "_y", "_b").mapInPandas(counted, "k long, node long, h binary")
        found = sums.groupBy("k", "node").applyInPandas(
            chosen, "k long, i long, node long, feature long, cut long, a long, b long, weight double"
        )
        for r in found.collect():  # a row for each node of each tree
            tree = trees[shared[r.k][r.i]]
            tree.counts[r.node] = (r.a, r.b)
            tree.positive = r.weight
            if r.feature >= 0:
                tree.feature[r.node], tree.cut[r.node] = r.feature, r.cut
    return trees


def alike(trees: dict[Fit, Grown]) -> list[list[Fit]]:
    """Fits with the same rows and cuts: one walk through the tree of the first tells for all."""
    out: dict[tuple, list[Fit]] = defaultdict(list)
    for f, t in trees.items():
        out[(f.outer, f.inner, *sorted((n, k, t.cut[n]) for n, k in t.feature.items()))].append(f)
    return list(out.values())


def held_counts(rows: DataFrame, trees: dict[Fit, Grown]) -> dict[Fit, dict[int, tuple[int, int]]]:
    """Negatives and positives of each fit's inner fold in each leaf of its tree."""
    shared = alike(trees)
    by = defaultdict(lambda: defaultdict(list))
    for k, same in enumerate(shared):
        by[same[0].outer][str(same[0].inner)].append((k, trees[same[0]]))

    def counted(batches: Iterator[pd.DataFrame], by={o: dict(x) for o, x in by.items()}) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(2, np.int64))
        for pdf in batches:
            for o, fold, bins, y in _parts(pdf):
                for k, tree in by.get(o, {}).get(fold, ()):
                    nodes, nth = np.unique(tree.nodes(bins), return_inverse=True)
                    counts = np.bincount(2 * nth + y, minlength=2 * len(nodes)).reshape(-1, 2)
                    for node, count in zip(nodes.tolist(), counts, strict=True):
                        total[k, node] += count
        yield pd.DataFrame(
            [(k, node, int(x[0]), int(x[1])) for (k, node), x in total.items()], columns=["k", "node", "a", "b"]
        ).astype("int64")

    found = rows.select("_o", "_f", "_y", "_b").mapInPandas(counted, "k long, node long, a long, b long")
    out: dict[Fit, dict[int, tuple[int, int]]] = defaultdict(dict)
    for r in found.groupBy("k", "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        for f in shared[r.k]:
            out[f][r.node] = (r.a, r.b)
    return out


def average_precision(scored: Sequence[tuple[float, int, int]]) -> float | None:
    """Of (score, negatives, positives); equal scores count as one step."""
    total: dict[float, np.ndarray] = defaultdict(lambda: np.zeros(2))
    for score, a, b in scored:
        total[round(score, 12)] += (a, b)
    table = np.array([total[s] for s in sorted(total, reverse=True)])
    if not len(table) or not table[:, 1].sum() or not table[:, 0].sum():
        return None
    run = table.cumsum(axis=0)
    return float((table[:, 1] * run[:, 1] / run.sum(axis=1)).sum() / table[:, 1].sum())


def nested_search(
    design: DataFrame,
    outer: str,
    fold: str,
    folds: Sequence[str],
    trials: Sequence[dict],
    keep: Sequence[str],
    bins: int = 32,
) -> tuple[DataFrame, dict[str, tuple[dict, float]]]:
    """Predictions of every outer fold by the setting its inner folds like best, and these settings.

    ``design`` has the rows of each outer fold's run, marked by ``outer``, since
    features may depend on what is held out; ``trials`` have maxDepth and
    minInstancesPerNode. A setting's score is the mean average precision over the
    inner folds that have both labels; of equal ones the first trial wins. The
    predictions have the ``keep`` columns, ``outer`` and ``score``.
    """
    width = len(design.select(_values(design)).first()[0])
    edges = outer_edges(design, outer, fold, folds, width, bins)
    size = max(len(e) for per in edges.values() for e in per) + 1
    rows = binned(design, outer, fold, edges, keep)
    depth = max(t["maxDepth"] for t in trials)
    least = sorted({t["minInstancesPerNode"] for t in trials})
    fits = [Fit(o, i, m) for o in folds for i in folds if i != o for m in least]
    trees = grow(rows, fits, depth, width, size)
    held = held_counts(rows, trees)
    best: dict[str, tuple[dict, float]] = {}
    for o in folds:
        scores = []
        for t in trials:
            told = []
            for i in folds:
                f = Fit(o, i, t["minInstancesPerNode"])
                if i != o:
                    share = trees[f].shares(t["maxDepth"])
                    told.append(average_precision([(share[n][1], a, b) for n, (a, b) in held.get(f, {}).items()]))
            told = [x for x in told if x is not None]
            scores.append(np.mean(told) if told else -1.0)
        at = int(np.argmax(np.round(scores, 12)))
        best[o] = (trials[at], float(scores[at]))
    chosen = {o: Fit(o, None, t["minInstancesPerNode"]) for o, (t, _) in best.items()}
    final = grow(rows, list(chosen.values()), depth, width, size)
    scores_of = {}
    for o, f in chosen.items():
        share = final[f].shares(best[o][0]["maxDepth"])
        nodes = np.array(sorted(share), np.int64)
        scores_of[o] = final[f], nodes, np.array([share[n][1] for n in nodes.tolist()])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, names = [], []
            for o, y, b in zip(*(batch.column(c).to_pylist() for c in ("_o", "_y", "_b")), strict=True):
                tree, nodes, scores = scores_of[o]
                each.append(scores[np.searchsorted(nodes, tree.nodes(_bins(b, len(y))))])
                names += [o] * len(y)
            kept = [batch.column(c).flatten() for c in keep]
            score = np.concatenate([np.zeros(0), *each])
            yield pa.record_batch([*kept, pa.array(names, pa.string()), score], [*keep, outer, "score"])

    names = [f"`{c}` {design.schema[c].dataType.simpleString()}" for c in keep]
    held_out = rows.where(F.col("_o") == F.col("_f"))
    return held_out.mapInArrow(predicted, ", ".join([*names, f"`{outer}` string", "score double"])), best
