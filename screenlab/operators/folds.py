"""Splits and cross-validation folds, as small fold tables and role columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlab import schema
from screenlab.operators.ordered import row_numbers

ANSWERS = ("p", "fc", "label")


def split_by(df: DataFrame, column: str, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(train, test): test holds the rows whose column is among the values."""
    inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.where(~inside), df.where(inside)


def natural(column: str) -> list[Column]:
    """Chromosome order: by length of the name, then by name."""
    return [F.length(column), F.col(column)]


def group_folds(
    df: DataFrame, group: str, minimum: int = schema.MIN_FOLD_RECORDS
) -> DataFrame:
    """Groups large enough to be a fold: (fold, n, next_fold), next_fold rotating.

    A row per group; rows without a group never make a fold.
    """
    sizes = (
        df.where(F.col(group).isNotNull() & (F.col(group) != ""))
        .groupBy(F.col(group).alias("fold"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= minimum)
    )
    w = Window.partitionBy(F.lit(0)).orderBy(*natural("fold"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.select(
        "fold",
        "n",
        F.coalesce(F.lead("fold").over(w), F.first("fold").over(whole)).alias("next_fold"),
    )


def fold_role(group: str, fold: str, early_stop: str | None = None) -> Column:
    """validation / early_stop / train for one fold; a row without group trains."""
    role = F.when(F.col(group) == fold, "validation")
    if early_stop is not None:
        role = role.when(F.col(group) == early_stop, "early_stop")
    return role.otherwise("train")


def fold_sizes(folds: DataFrame, total: Column) -> DataFrame:
    """(fold, role, rows) of every fold, from the group sizes alone."""
    sizes = folds.select(F.col("fold").alias("_f"), F.col("n").alias("_next_n"))
    joined = folds.join(sizes, F.col("next_fold") == F.col("_f"))
    other = total - F.col("n") - F.col("_next_n")
    roles = F.array(
        F.struct(F.lit("validation").alias("role"), F.col("n").alias("rows")),
        F.struct(F.lit("early_stop").alias("role"), F.col("_next_n").alias("rows")),
        F.struct(F.lit("train").alias("role"), other.alias("rows")),
    )
    return joined.select("fold", F.explode(roles).alias("x")).select("fold", "x.*")


def stratified_folds(df: DataFrame, label: str, order: str, k: int) -> DataFrame:
    """``fold`` 0..k-1 dealt round-robin within each label, in the order of a
    shuffled numeric key that is unique per row."""
    return row_numbers(df, [label], order, "_rn").select(
        *df.columns, ((F.col("_rn") - 1) % k).cast("int").alias("fold")
    )


def carve_out(df: DataFrame, label: str, order: str, tenths: int = 1) -> DataFrame:
    """``held`` for a stratified tenth (or several) of the rows."""
    folds = stratified_folds(df, label, order, 10)
    return folds.select(*df.columns, (F.col("fold") < tenths).alias("held"))


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, pos, n, fold): whole groups, each put where it evens the classes most.

    Groups come in order of how uneven their two classes are, then by name. Each
    goes to the fold that leaves the least spread over the folds, averaged over
    the classes' shares; of equal ones (to nine digits) to the smallest, then to
    the first. The assignment depends on all before it, so one task walks over
    the sorted group table, a row a group, and holds k running totals.
    """
    sizes = df.groupBy(group).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    total = sizes.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    classes = np.array([total.pos or 0, (total.n or 0) - (total.pos or 0)], float)
    classes[classes == 0] = np.inf

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((k, 2))
        for pdf in batches:
            out = []
            for pos, n in zip(pdf["pos"], pdf["n"], strict=True):
                own = np.array([pos, n - pos], float)
                # Held by each fold if the group goes to fold i: (i, fold, class).
                after = held[None] + np.eye(k)[:, :, None] * own
                spread = (after / classes).std(axis=1).mean(axis=1).round(9)
                at = min(range(k), key=lambda i: (spread[i], held[i].sum(), i))
                held[at] += own
                out.append(at)
            yield pdf.assign(fold=np.array(out, np.int32))

    order = [F.abs(F.col("n") - 2 * F.col("pos")).desc(), F.col(group)]
    kind = df.schema[group].dataType.simpleString()
    walked = sizes.select(group, "pos", "n").repartition(1).sortWithinPartitions(*order)
    return walked.mapInPandas(dealt, f"`{group}` {kind}, pos long, n long, fold int")


def fold_pairs(folds: DataFrame) -> Column:
    """All folds with their early-stop fold as one array of (fold, next_fold)."""
    return folds.agg(F.collect_list(F.struct("fold", "next_fold")).alias("f")).scalar()


def fold_roles(df: DataFrame, group: str, folds: DataFrame) -> DataFrame:
    """Every row once a fold, with ``fold`` and its ``role`` there; rows in no fold always train."""
    spread = df.select("*", F.explode(fold_pairs(folds)).alias("_f"))
    role = F.when(F.col(group) == F.col("_f.fold"), "validation").when(
        F.col(group) == F.col("_f.next_fold"), "early_stop"
    )
    return spread.select(*df.columns, F.col("_f.fold").alias("fold"), role.otherwise("train").alias("role"))


def fold_vocabulary(seen: DataFrame, group: str, folds: DataFrame) -> DataFrame:
    """(fold, kmer): k-mers of each fold's training rows, from (group, kmer) of all rows in one pass.

    A k-mer is a fold's unless only its validation and early-stop groups have it.
    """
    seen = seen.select(F.col(group).alias("_g"), "kmer").distinct()
    holders = seen.groupBy("kmer").agg(F.count(F.lit(1)).alias("_n"))
    wide = holders.select("kmer", "_n", F.explode(fold_pairs(folds)).alias("_f"))
    wide = wide.select("kmer", "_n", "_f.fold", "_f.next_fold")
    for column, name in (("fold", "_v"), ("next_fold", "_e")):
        own = seen.select(F.col("_g").alias(column), "kmer", F.lit(1).alias(name))
        wide = wide.join(own, [column, "kmer"], "left")
    early = F.when(F.col("fold") == F.col("next_fold"), 0).otherwise(F.coalesce("_e", F.lit(0)))
    return wide.where(F.col("_n") > F.coalesce("_v", F.lit(0)) + early).select("fold", "kmer")


def publish_holdout(
    df: DataFrame, column: str, value: str, exclude: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Training rows, held-out rows without the answers, and the answers apart."""
    train, held = split_by(df, column, [value])
    if exclude:
        train = train.where(~F.col(column).isin(*exclude))
    return {
        "train": train,
        "features": held.drop(*ANSWERS),
        "labels": held.select("target", column, "label"),
    }


def leaked_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in ANSWERS]
