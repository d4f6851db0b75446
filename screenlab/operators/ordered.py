"""Order statistics that never put one group into one task.

A plain ``rank() over (partition by g order by v)`` sends every row of ``g`` to
one task.  Here the rows are first reduced to one per distinct value, the value
axis is cut into blocks at approximate quantiles, sums run inside each
(group, block), and the sums of the earlier blocks are added from a table with
one row per (group, block).  Only the speed depends on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MAX_BLOCKS = 4096


def block_count(df: DataFrame) -> int:
    """Power of two near twice the number of shuffle partitions."""
    wanted = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 16
    while size < min(wanted, _MAX_BLOCKS):
        size *= 2
    return size


def with_blocks(df: DataFrame, value: str, blocks: int | None = None) -> DataFrame:
    """Add ``_block``: which quantile block of the whole table ``value`` falls in.

    The cuts are one row of at most ``blocks`` values, read as a scalar subquery
    and searched by bisection.
    """
    blocks = blocks or block_count(df)
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = df.agg(
        F.percentile_approx(value, cuts, max(1000, 4 * blocks)).alias("b")
    ).scalar()
    steps = []
    step = blocks // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    found = F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, step: at
        + F.when(F.get(F.col("_cuts"), at + step - 1) < F.col(value), step).otherwise(F.lit(0)),
    )
    return df.select("*", bounds.alias("_cuts")).select(*df.columns, found.alias("_block"))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match; the keys come from the left side."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Add ``run_<s>`` (inclusive) and ``all_<s>`` for a frame unique on (by, value)."""
    by = list(by)
    blocked = with_blocks(df, value, blocks)
    block_order = F.desc("_block") if descending else F.asc("_block")
    value_order = F.desc(value) if descending else F.asc(value)
    # at most `blocks` rows per group
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*by, "_block")
        .agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
        .select(
            *by,
            "_block",
            *[
                F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}")
                for s in sums
            ],
            *[F.sum(f"_t_{s}").over(group).alias(f"all_{s}") for s in sums],
        )
    )
    inside = (
        Window.partitionBy(*by, "_block")
        .orderBy(value_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocked.select("*", *[F.sum(s).over(inside).alias(f"_w_{s}") for s in sums])
    joined = null_safe_join(local, offsets, [*by, "_block"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_w_{s}") + F.col(f"_o_{s}")).alias(f"run_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
    )


def rank_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per (by, value): ties ``n``, ``avg_rank``, ``group_n``, ``run_n``."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ran = running_sums(counted, by, value, ["n"])
    return ran.select(
        *by,
        value,
        "n",
        "run_n",
        F.col("all_n").alias("group_n"),
        (F.col("run_n") - (F.col("n") - 1) / 2.0).alias("avg_rank"),
    )


def with_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str = "avg_rank", pct: bool = False
) -> DataFrame:
    """Average rank of each row in its group (ties share the mean rank).

    The join back is on (by, value): one row on the rank side, so a value held
    by a third of all rows is split over tasks by adaptive skew handling.
    """
    table = rank_table(df, by, value)
    rank = F.col("avg_rank") / F.col("group_n") if pct else F.col("avg_rank")
    ranks = table.select(*by, value, rank.alias(out))
    return null_safe_join(df, ranks, [*by, value], "left")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name in ``qs``."""
    table = rank_table(df, by, value)
    first = F.col("run_n") - F.col("n")
    aggs = [F.max("group_n").alias("_n")]
    for name, q in qs.items():
        at = (F.col("group_n") - 1) * F.lit(float(q))
        for tag, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (first <= index) & (index < F.col("run_n"))
            aggs.append(F.max(F.when(held, F.col(value))).alias(f"_{tag}_{name}"))
    wide = table.groupBy(*by).agg(*aggs)
    out = []
    for name, q in qs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return wide.select(*by, *out)


def row_numbers(
    df: DataFrame, by: Sequence[str], order: str, out: str = "rn", descending: bool = False
) -> DataFrame:
    """1-based position by ``order``, which must be unique within its group."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    ran = running_sums(ones, by, order, ["_one"], descending)
    return ran.withColumn(out, F.col("run__one")).drop("_one", "run__one", "all__one")


def first_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]
) -> DataFrame:
    """The row that sorts first per key, as one partially aggregated ``min``.

    ``order`` must contain only ascending, comparable columns; negate numbers to
    sort downwards.  No window, so a hot key is reduced before the shuffle.
    """
    packed = F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in keep]
    )
    best = df.groupBy(*keys).agg(F.min(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep])
