"""A generalised additive model with pairwise terms, learnt by cyclic boosting.

Features are cut into bins.  In each round every feature in turn gets a shallow
tree over its bins, fitted to what is left to explain; the trees of a feature
add up to one lookup table.  Then the pairs of features that explain most of
the rest get tables of their own.  A score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, PAIR_BINS = 32, 8


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for p in self.pairs for k in p}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at about equal counts."""
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))
    values = np.unique(x)
    after = np.searchsorted(values, cuts, "right")
    inner = after < len(values)
    return np.unique((values[after[inner] - 1] + values[after[inner]]) / 2)


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """(gain, bins to the left) of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = _gain(gl, hl, l2) + _gain(gr, hr, l2) - _gain(g.sum(), h.sum(), l2)
    gain[(hl < least) | (hr < least)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, l2: float, least: float, depth: int = 2) -> np.ndarray:
    """The value of each bin under a shallow tree."""
    gain, k = _best_cut(g, h, l2, least) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + l2))
    return np.r_[_tree(g[:k], h[:k], l2, least, depth - 1), _tree(g[k:], h[k:], l2, least, depth - 1)]


def _cross(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, table) of the best cut along one axis with the best cut of each side along the other."""
    best, table = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(gg)):
            sides, total = [], 0.0
            for part in (slice(None, k), slice(k, None)):
                a, b = gg[part].sum(0), hh[part].sum(0)
                gain, cut = _best_cut(a, b, l2, least)
                total += gain
                value = np.full(len(a), a.sum() / (b.sum() + l2))
                if gain > 0:
                    value[:cut] = a[:cut].sum() / (b[:cut].sum() + l2)
                    value[cut:] = a[cut:].sum() / (b[cut:].sum() + l2)
                sides.append(np.repeat(value[None], gg[part].shape[0], 0))
                total += _gain(a.sum(), b.sum(), l2)
            total -= _gain(gg.sum(), hh.sum(), l2)
            if total > best:
                best, table = total, np.concatenate(sides)
                table = table.T if flip else table
    return best, table


def fit(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 150,
    pairs: int = 5,
    pair_rounds: int = 50,
    rate: float = 0.15,
    l2: float = 1.0,
    least: float = 1.0,
) -> AdditiveModel:
    """Learn from rows x features and 0/1 labels.

    Without rows the score is one half everywhere; with labels of one kind it is
    their smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    features = x.shape[1]
    model.edges = [_edges(x[:, k], BINS) for k in range(features)]
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(features)]
    fine = [np.searchsorted(model.edges[k], x[:, k], "right") for k in range(features)]
    rough = [np.searchsorted(model.pair_edges[k], x[:, k], "right") for k in range(features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.base)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(features):
            g, h = rest()
            n = len(model.tables[k])
            step = rate * _tree(np.bincount(fine[k], g, n), np.bincount(fine[k], h, n), l2, least)
            model.tables[k] += step
            logit += step[fine[k]]

    def histograms(a: int, b: int) -> tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        at = rough[a] * shape[1] + rough[b]
        g, h = rest()
        n = shape[0] * shape[1]
        return shape, at, np.bincount(at, g, n).reshape(shape), np.bincount(at, h, n).reshape(shape)

    gains = []
    for a in range(features):
        for b in range(a + 1, features):
            _, _, g, h = histograms(a, b)
            gains.append((_cross(g, h, l2, least)[0], a, b))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1:]))[:pairs]
    model.pairs = [(a, b) for gain, a, b in chosen if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            shape, at, g, h = histograms(a, b)
            step = rate * _cross(g, h, l2, least)[1]
            model.pair_tables[k] += step
            logit += step.ravel()[at]
    return model
