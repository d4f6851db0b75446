"""How well does -mean(fc) over the other cell lines rank a held-out line's hits?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators.metrics import ranking_metrics
from screenlab.operators.screen import leave_one_out
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all
from screenlab.plans.sqltext import ap_auroc

def held_out_priors(spark: SparkSession, sf: str) -> DataFrame:
    gene = roles.gene(spark, sf)
    prior = leave_one_out(gene, "target", "cell", ["fc"], ["mean"])
    scored = prior.select(
        "cell", "label", F.coalesce(F.round(-F.col("fc_mean"), 9), F.lit(0.0)).alias("score")
    )
    return ranking_metrics(scored, ["cell"], "score", "label")


@query(
    "held_out_prior_ranking",
    """
, other AS (SELECT a.target, a.cell, a.label,
    coalesce(round(-avg(b.fc), 9), 0) + 0e0 AS score
  FROM gene a LEFT JOIN gene b ON a.target = b.target AND a.cell <> b.cell
  GROUP BY a.target, a.cell, a.label)
"""
    + ap_auroc("other", "cell")
    + """
SELECT cell, n, n_pos, round(auroc, 9) + 0e0 AS auroc, round(auprc, 9) + 0e0 AS auprc FROM ap_out
""",
    ("gene",),
)
def held_out_prior_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(held_out_priors(spark, sf), ["auroc", "auprc"])
