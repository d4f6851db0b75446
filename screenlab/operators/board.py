"""Submission checks, scoring and ranking, for all submissions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlab.operators.metrics import ranking_metrics

# The columns of a submission, its metadata fields, and the
# pattern of a handle.
COLUMNS = ("target", "cell_line", "y_pred_proba")
METADATA = ("submitter", "model", "uses_measured_depletion")
HANDLE = r"^[A-Za-z\d](?:[A-Za-z\d]|-(?=[A-Za-z\d])){0,38}$"


def missing_columns(have: Sequence[str], required: Sequence[str] = COLUMNS) -> list[str]:
    return [c for c in required if c not in have]


def metadata_problems(meta: dict) -> list[str]:
    """What is wrong with a submission's metadata; empty when nothing is."""
    import re

    problems = [f"missing field {f}" for f in METADATA if f not in meta]
    handle = meta.get("submitter")
    if handle is not None and not re.match(HANDLE, str(handle)):
        problems.append(f"bad handle {handle!r}")
    flag = meta.get("uses_measured_depletion")
    if flag is not None and not isinstance(flag, bool):
        problems.append("uses_measured_depletion must be true or false")
    return problems


def valid_handle(handle: Column) -> Column:
    return handle.rlike(HANDLE)


def duplicate_keys(df: DataFrame, sub: str, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(sub, *keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def missing_keys(df: DataFrame, truth: DataFrame, sub: str, keys: Sequence[str]) -> DataFrame:
    """Per submission, how many truth keys it lacks: counted, not paired."""
    have = df.select(sub, *keys).distinct().join(truth.select(*keys), list(keys), "left_semi")
    total = truth.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        df.select(sub)
        .distinct()
        .join(have.groupBy(sub).agg(F.count(F.lit(1)).alias("have")), sub, "left")
        .select(sub, (total - F.coalesce("have", F.lit(0))).alias("missing"))
    )


def extra_keys(
    df: DataFrame, truth: DataFrame, excluded: DataFrame, sub: str, keys: Sequence[str]
) -> DataFrame:
    """Submitted keys that are neither in the truth nor on the excluded list."""
    return (
        df.select(sub, *keys)
        .distinct()
        .join(truth, list(keys), "left_anti")
        .join(excluded, list(keys), "left_anti")
    )


def bad_score(score: str) -> Column:
    """True for text that is not a finite number."""
    x = F.expr(f"try_cast({score} AS double)")
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def problem_list(
    df: DataFrame, truth: DataFrame, excluded: DataFrame, sub: str, keys: Sequence[str], score: str
) -> DataFrame:
    """(submission, problem, n) for every problem found without using labels.

    One grouping of the submissions by key, one join with the known keys, one
    grouping of what came out.
    """
    k = list(keys)
    each = df.groupBy(sub, *k).agg(F.count(F.lit(1)).alias("_copies"), F.count_if(bad_score(score)).alias("_bad"))
    known = truth.select(*k, F.lit(1).alias("_truth")).unionByName(excluded.select(*k, F.lit(0).alias("_truth")))
    known = known.groupBy(*k).agg(F.max("_truth").alias("_truth"))
    total = truth.select(*k).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = each.join(known, k, "left").groupBy(sub).agg(
        F.count_if(F.col("_copies") > 1).alias("duplicate"),
        (total - F.count_if(F.col("_truth") == 1)).alias("missing"),
        F.count_if(F.col("_truth").isNull()).alias("extra"),
        F.sum("_bad").alias("not a finite number"),
    )
    names = ("duplicate", "missing", "extra", "not a finite number")
    told = F.inline(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("n")) for n in names]))
    return counts.select(sub, told).where(F.col("n") > 0)


def metadata_problem_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``problems``: what `metadata_problems` finds, for a row a submission.

    Fields are text columns or missing (null); the flag is "true" or "false".
    """
    lacking = [F.when(F.col(f).isNull(), F.lit(f"missing field {f}")) for f in METADATA]
    handle = F.when(~valid_handle(F.col("submitter")), F.concat(F.lit("bad handle "), "submitter"))
    flag = F.when(
        ~F.col("uses_measured_depletion").isin("true", "false"), F.lit("uses_measured_depletion must be true or false")
    )
    return df.withColumn("problems", F.array_compact(F.array(*lacking, handle, flag)))


def score_all(
    df: DataFrame, truth: DataFrame, sub: str, keys: Sequence[str], score: str, label: str
) -> DataFrame:
    """Metrics of every submission against the held-out truth, never its own copy."""
    joined = df.select(sub, *keys, score).join(truth.select(*keys, label), list(keys))
    m = ranking_metrics(joined, [sub], score, label)
    base = F.try_divide(F.col("n_pos"), F.col("n"))
    return m.select("*", base.alias("base_rate"), F.try_divide(F.col("auprc"), base).alias("lift"))


def leaderboard(scores: DataFrame, sub: str, eligible: str) -> DataFrame:
    """Rank by AUPRC among eligible submissions; the others are listed unranked.

    One row per submission, so the window holds a list people read.
    """
    w = Window.partitionBy(eligible).orderBy(F.desc("auprc"), F.asc(sub))
    place = F.row_number().over(w)
    return scores.withColumn("place", F.when(F.col(eligible), place))
