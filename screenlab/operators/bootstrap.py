"""Percentile bootstrap of average precision.

Every replicate needs a draw per row, so the draws are made inside the tasks
that hold the rows, per block of neighbouring scores: the first pass sends out
the number of drawn rows and positives of each block for each replicate, the
second repeats the same seeded draws with the totals of the higher blocks and
sends out each block's share of the average precision.  What is shuffled is
blocks x replicates, not rows x replicates.

Rows are drawn by independent Poisson(1) counts, the large-sample form of
drawing n rows with replacement.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlab.operators.metrics import ranking_from_table, score_table
from screenlab.operators.ordered import null_safe_join, quantiles, with_blocks

_CHUNK = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(key: np.ndarray, replicate: np.ndarray, seed: int, kind: int) -> np.ndarray:
    """A number in [0, 1) for each (replicate, key): a mixed hash of both, the seed and the kind."""
    x = key[None, :] + ((replicate.astype(np.uint64) * np.uint64(2) + np.uint64(kind)) * _STEP)[:, None]
    x = x + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson counts by inverting the distribution, a column of u for each mean."""
    out = np.zeros(u.shape, np.int64)
    for m in np.unique(mean[mean > 0]):
        k = np.arange(int(m + 12 * np.sqrt(m) + 25))
        logs = np.r_[0.0, np.cumsum(np.log(np.arange(1, len(k))))]
        cdf = np.cumsum(np.exp(k * np.log(m) - m - logs))
        at = mean == m
        out[:, at] = np.searchsorted(cdf, u[:, at], side="right")
    return out


def _draws(pdf: pd.DataFrame, replicates: int, seed: int):
    """(first replicate, rows drawn, positives drawn) in chunks.

    A draw depends on the group, the score, the replicate and the seed alone, so
    no way of cutting the rows into blocks changes it.
    """
    pos = pdf["pos"].to_numpy(dtype=np.int64)
    neg = pdf["n"].to_numpy(dtype=np.int64) - pos
    key = pdf["_salt"].to_numpy(dtype=np.int64).astype(np.uint64)
    for start in range(0, replicates, _CHUNK):
        at = np.arange(start, min(start + _CHUNK, replicates))
        p = _poisson(pos, _uniform(key, at, seed, 0))
        yield start, p + _poisson(neg, _uniform(key, at, seed, 1)), p


def ap_replicates(
    df: DataFrame, by: Sequence[str], score: str, label: str, replicates: int = 2000, seed: int = 0, blocks: int | None = None
) -> DataFrame:
    """(by, replicate, ap); replicates without a positive are left out."""
    by = list(by)
    table = with_blocks(score_table(df, by, score, label), score, blocks)
    salt = F.xxhash64(*[F.col(c).cast("string") for c in by], F.col(score).cast("double"))
    table = table.withColumn("_salt", salt).withColumn("_g", F.to_json(F.struct(F.lit(0).alias("_"), *by)))

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(score, ascending=False)
        parts = [
            pd.DataFrame({"replicate": start + np.arange(len(n)), "n": n.sum(1), "tp": p.sum(1)})
            for start, n, p in _draws(pdf, replicates, seed)
        ]
        out = pd.concat(parts)
        out["_g"], out["_block"] = pdf["_g"].iloc[0], pdf["_block"].iloc[0]
        return out[["_g", "_block", "replicate", "n", "tp"]]

    per_block = table.groupBy("_g", "_block").applyInPandas(
        totals, "_g string, _block int, replicate int, n long, tp long"
    )

    def offsets(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows and positives drawn in the higher blocks, as arrays over replicates."""
        n = pdf.pivot(index="_block", columns="replicate", values="n").sort_index(ascending=False)
        tp = pdf.pivot(index="_block", columns="replicate", values="tp").sort_index(ascending=False)
        before_n, before_tp = n.cumsum() - n, tp.cumsum() - tp
        return pd.DataFrame(
            {
                "_g": pdf["_g"].iloc[0],
                "_block": n.index.astype("int32"),
                "n0": [row.tolist() for row in before_n.to_numpy(dtype=np.int64)],
                "tp0": [row.tolist() for row in before_tp.to_numpy(dtype=np.int64)],
            }
        )

    starts = per_block.groupBy("_g").applyInPandas(
        offsets, "_g string, _block int, n0 array<long>, tp0 array<long>"
    )

    def shares(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf = left.sort_values(score, ascending=False)
        n0 = np.asarray(right["n0"].iloc[0], dtype=np.float64)
        tp0 = np.asarray(right["tp0"].iloc[0], dtype=np.float64)
        parts = []
        for start, n, p in _draws(pdf, replicates, seed):
            at = slice(start, start + len(n))
            run_n = n.cumsum(1) + n0[at, None]
            run_p = p.cumsum(1) + tp0[at, None]
            gain = (p * run_p / np.maximum(run_n, 1.0)).sum(1)
            parts.append(
                pd.DataFrame({"replicate": start + np.arange(len(n)), "gain": gain, "tp": p.sum(1)})
            )
        out = pd.concat(parts)
        out["_g"] = pdf["_g"].iloc[0]
        return out[["_g", "replicate", "gain", "tp"]]

    keys = ["_g", "_block"]
    summed = (
        table.groupBy(*keys)
        .cogroup(starts.groupBy(*keys))
        .applyInPandas(shares, "_g string, replicate int, gain double, tp long")
        .groupBy("_g", "replicate")
        .agg(F.sum("gain").alias("_gain"), F.sum("tp").alias("_tp"))
        .where(F.col("_tp") > 0)
    )
    groups = table.select("_g", *by).distinct()
    return summed.join(groups, "_g").select(
        *by, "replicate", (F.col("_gain") / F.col("_tp")).alias("ap")
    )


def ap_interval(
    df: DataFrame, by: Sequence[str], score: str, label: str, replicates: int = 2000, seed: int = 0
) -> DataFrame:
    """Point estimate, 95% interval, its width, and the smallest gap worth reading."""
    reps = ap_replicates(df, by, score, label, replicates, seed)
    ends = quantiles(reps, by, "ap", {"ci_low": 0.025, "ci_high": 0.975})
    point = ranking_from_table(score_table(df, by, score, label), by, score)
    width = F.col("ci_high") - F.col("ci_low")
    base = F.try_divide(F.col("n_pos"), F.col("n"))
    return null_safe_join(point, ends, by, "left").select(
        "*",
        base.alias("base_rate"),
        F.try_divide(F.col("auprc"), base).alias("lift"),
        width.alias("ci_width"),
        (width / 2.0).alias("smallest_gap"),
    )
