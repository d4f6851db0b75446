"""Sweep-summary queries over a results table made from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators import sweep
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all
from screenlab.plans.sqltext import r

_RESULTS = """
, results AS (SELECT l_returnflag || l_linestatus AS config, CAST(l_linenumber AS VARCHAR) AS fold,
   CAST(l_suppkey % 10 AS INT) AS seed,
   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / (count(*) * 1e8) AS value,
   CAST(sum(l_quantity) AS BIGINT) AS trees
  FROM lineitem GROUP BY ALL)
"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return (
        roles.table(spark, sf, "lineitem")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("config"),
            F.col("l_linenumber").cast("string").alias("fold"),
            (F.col("l_suppkey") % 10).cast("int").alias("seed"),
        )
        .agg(
            (cents / (F.count(F.lit(1)) * F.lit(1e8))).alias("value"),
            F.sum("l_quantity").cast("bigint").alias("trees"),
        )
    )


@query(
    "sweep_config_summary",
    _RESULTS
    + f"""
, c AS (SELECT config, avg(value) AS m, stddev_pop(value) AS s, count(*) AS runs FROM results GROUP BY config)
, b AS (SELECT m AS b FROM c WHERE config = 'AF')
SELECT config, {r('m', 'mean')}, {r('s', 'sd')}, runs, {r('m - b', 'delta')}, abs(m - b) < 0.02 AND config <> 'AF' AS noise FROM c, b""",
)
def sweep_config_summary(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(sweep.config_summary(_results(spark, sf), "AF"), ["mean", "sd", "delta"])


@query(
    "sweep_paired_comparison",
    _RESULTS
    + f"""
, f AS (SELECT x.config, fold, count(*) AS n, count(*) FILTER (x.value > y.value) AS w, avg(x.value) - avg(y.value) AS d
  FROM results x JOIN results y USING (fold, seed) WHERE x.config <> 'AF' AND y.config = 'AF' GROUP BY x.config, fold)
SELECT config, CAST(sum(w) AS BIGINT) AS wins, CAST(sum(n) AS BIGINT) AS pairs, {r('min(d)', 'lowest_delta')},
  {r('max(d)', 'highest_delta')}, NOT (min(d) < 0 AND max(d) > 0) AS sign_consistent FROM f GROUP BY config""",
)
def sweep_paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    out = sweep.paired_comparison(_results(spark, sf), "AF")
    return round_all(out, ["lowest_delta", "highest_delta"])


@query(
    "sweep_folds_won",
    _RESULTS
    + f"""
, m AS (SELECT config, fold, avg(value) AS m FROM results GROUP BY config, fold)
, b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, config) AS k FROM m)
SELECT config, {r('avg(m)', 'mean')}, count(*) FILTER (k = 1) AS won FROM b GROUP BY config""",
)
def sweep_folds_won(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(sweep.folds_won(_results(spark, sf)), ["mean"])


@query(
    "trial_summary",
    _RESULTS
    + f"""SELECT config, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, median(trees) AS median_trees,
  count(*) AS folds FROM results GROUP BY config""",
)
def trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(sweep.trial_summary(_results(spark, sf), "trees"), ["mean", "sd"])


@query(
    "best_trial",
    _RESULTS
    + f"""SELECT config, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')}, median(trees) AS median_trees,
  count(*) AS folds FROM results GROUP BY config ORDER BY avg(value) DESC, config LIMIT 1""",
)
def best_trial(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(sweep.best_trial(_results(spark, sf), "trees"), ["mean", "sd"])


@query(
    "sweep_runs",
    """, c AS (SELECT unnest(['mean', 'half']) AS config), f AS (SELECT DISTINCT cell AS fold FROM gene WHERE cell IN ('RF', 'RO'))
, s AS (SELECT unnest([1, 2]) AS seed)
SELECT config, fold, CAST(seed AS INT) AS seed, round((SELECT avg(abs(label - CASE config WHEN 'half' THEN 0.5e0
    ELSE (SELECT avg(label) FROM gene b WHERE b.cell <> fold AND (b.target + seed) % 3 <> 0) END)) FROM gene a WHERE a.cell = fold), 9) + 0e0 AS value
FROM c, f, s""",
    ("gene",),
)
def sweep_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two baselines over two folds and two seeds: absolute error on the fold, fitted on two thirds of the rest."""
    gene = roles.gene(spark, sf)

    def one(config: str, fold: str, seed: int) -> DataFrame:
        train = gene.where((F.col("cell") != fold) & ((F.col("target") + seed) % 3 != 0))
        guess = train.agg(F.avg("label").alias("m")).scalar() if config == "mean" else F.lit(0.5)
        held = gene.where(F.col("cell") == fold).select(F.abs(F.col("label") - guess).alias("e"))
        return held.agg(F.avg("e").alias("value"))

    return round_all(sweep.run_sweep(["mean", "half"], ["RF", "RO"], [1, 2], one), ["value"])
