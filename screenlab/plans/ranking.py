"""Ranks, metrics, ensembles and leaderboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators import board, bootstrap, ensemble, metrics
from screenlab.operators.ordered import quantiles, with_rank
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all, rounded
from screenlab.plans.sqltext import ap_auroc, avg_rank, corr, pct_rank, r

SETS = [[], ["cell"], ["chrom"], ["cell", "chrom"]]


@query(
    "metric_grouping_sets",
    """
, rows AS (SELECT cell, chrom, -fc AS score, label FROM gene)
, spread AS (
  SELECT 'overall' AS split, NULL AS cell, NULL AS chrom, score, label FROM rows
  UNION ALL SELECT 'cell', cell, NULL, score, label FROM rows
  UNION ALL SELECT 'chrom', NULL, chrom, score, label FROM rows
  UNION ALL SELECT 'cell+chrom', cell, chrom, score, label FROM rows)
"""
    + ap_auroc("spread", "split, cell, chrom")
    + f"SELECT split, cell, chrom, n, n_pos, {r('auroc', 'auroc')}, {r('auprc', 'auprc')} FROM ap_out",
    ("gene",),
)
def metric_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.gene(spark, sf).select("cell", "chrom", (-F.col("fc")).alias("score"), "label")
    return round_all(
        metrics.ranking_metrics_by_sets(rows, SETS, "score", "label"), ["auroc", "auprc"]
    )


@query(
    "regression_metrics",
    f"""
, rows AS (SELECT cell, fc AS t, round((p - 0.5e0) / 10, 6) AS pr FROM gene)
, spread AS (SELECT 'overall' AS split, NULL AS cell, t, pr FROM rows
  UNION ALL SELECT 'cell', cell, t, pr FROM rows)
, ranked AS (SELECT *, {avg_rank('t', 'split, cell')} AS rt,
    {avg_rank('pr', 'split, cell')} AS rp FROM spread)
SELECT split, cell, count(*) AS n, {r(corr('t', 'pr'), 'pearson_r')},
  {r(corr('rt', 'rp'), 'spearman_rho')},
  {r('sqrt(avg((t - pr) * (t - pr)))', 'rmse')}, {r('avg(abs(t - pr))', 'mae')},
  {r('1 - sum((t - pr) * (t - pr)) / (var_pop(t) * count(*))', 'r2')}
FROM ranked GROUP BY split, cell""",
    ("gene",),
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.gene(spark, sf).select(
        "cell", F.col("fc").alias("t"), F.round((F.col("p") - 0.5) / 10, 6).alias("pr")
    )
    spread = metrics.over_sets(rows, [[], ["cell"]])
    out = metrics.regression_metrics(spread, ["split", "cell"], "t", "pr")
    return round_all(out, ["pearson_r", "spearman_rho", "rmse", "mae", "r2"])


@query(
    "classification_metrics",
    f"""
, rows AS (SELECT cell, round(1 - p, 6) AS score, label FROM gene)
"""
    + ap_auroc("rows", "cell")
    + f"""
, thr AS (SELECT cell, count(*) AS n, count(*) FILTER (label = 1) AS n_pos,
    count(*) FILTER (label = 1 AND score >= 0.95) AS tp, count(*) FILTER (score >= 0.95) AS said,
    count(*) FILTER ((score >= 0.95) = (label = 1)) AS good FROM rows GROUP BY cell)
SELECT cell, thr.n, thr.n_pos, {r('thr.n_pos / thr.n', 'pos_rate')},
  {r('coalesce(tp / nullif(said, 0), 0)', 'precision')},
  {r('coalesce(tp / nullif(thr.n_pos, 0), 0)', 'recall')},
  {r('coalesce(2 * tp / nullif(said + thr.n_pos, 0), 0)', 'f1')},
  {r('good / thr.n', 'accuracy')}, {r('auroc', 'auroc')}, {r('auprc', 'auprc')}
FROM thr JOIN ap_out USING (cell)""",
    ("gene",),
)
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.gene(spark, sf).select(
        "cell", F.round(1 - F.col("p"), 6).alias("score"), "label"
    )
    out = metrics.classification_metrics(rows, ["cell"], "score", "label", 0.95)
    names = ["pos_rate", "precision", "recall", "f1", "accuracy", "auroc", "auprc"]
    return round_all(out, names)


@query(
    "text_label_metrics_by_language",
    """
, rows AS (SELECT lang, n_chars * 1e0 AS score, toxic AS label
  FROM labels JOIN documents USING (doc_id))
"""
    + ap_auroc("rows", "lang")
    + f"SELECT lang, n, n_pos, {r('auroc', 'auroc')}, {r('auprc', 'auprc')} FROM ap_out",
)
def text_label_metrics_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """A language with one class only has no AUROC or AUPRC."""
    docs = roles.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = roles.table(spark, sf, "labels").join(docs, "doc_id")
    rows = rows.select("lang", F.col("n_chars").cast("double").alias("score"), "toxic")
    return round_all(
        metrics.ranking_metrics(rows, ["lang"], "score", "toxic"), ["auroc", "auprc"]
    )


@query(
    "roc_curve_points",
    f"""
, rows AS (SELECT cell, round(1 - p, 3) AS score, label FROM gene)
"""
    + ap_auroc("rows", "cell")
    + f"""
SELECT cell, score, CAST(n_s AS BIGINT) AS n, CAST(pos_s AS BIGINT) AS pos,
  CAST(cn AS BIGINT) AS cum_n, CAST(cp AS BIGINT) AS tp, CAST(cn - cp AS BIGINT) AS fp,
  CAST(tn AS BIGINT) AS group_n, CAST(ap_run.tp AS BIGINT) AS group_pos,
  {r('cp / ap_run.tp', 'tpr')}, {r('(cn - cp) / (tn - ap_run.tp)', 'fpr')},
  {r('cp / cn', 'precision')}
FROM ap_run""",
    ("gene",),
)
def roc_curve_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.gene(spark, sf).select(
        "cell", F.round(1 - F.col("p"), 3).alias("score"), "label"
    )
    out = metrics.curve_points(rows, ["cell"], "score", "label")
    return round_all(out, ["tpr", "fpr", "precision"])


@query(
    "hit_effect_size",
    """
, rows AS (SELECT 'all' AS g, s_acctbal_like AS score, ever AS label FROM (
    SELECT g.target, max(g.label) AS ever, round(avg(g.p), 9) AS s_acctbal_like
    FROM gene g GROUP BY g.target))
"""
    + ap_auroc("rows", "g")
    + f"""
, m AS (SELECT avg(score) FILTER (label = 1) AS a, avg(score) FILTER (label = 0) AS b FROM rows)
SELECT n, n_pos, {r('auroc', 'auroc')}, {r('a', 'mean_hit')}, {r('b', 'mean_rest')}
FROM ap_out, m""",
    ("gene",),
)
def hit_effect_size(spark: SparkSession, sf: str) -> DataFrame:
    """U / (n m) of a target feature for targets that are ever a hit against the rest."""
    per = roles.gene(spark, sf).groupBy("target").agg(
        F.max("label").alias("ever"), F.round(F.avg("p"), 9).alias("score")
    )
    out = metrics.effect_size(per, [], "score", "ever")
    return round_all(out.drop("p_value"), ["auroc", "mean_hit", "mean_rest"])


@query("hit_effect_p_value")
def hit_effect_p_value(spark: SparkSession, sf: str) -> DataFrame:
    """The same effect size with its two-sided normal p-value (tie-corrected)."""
    gene = roles.gene(spark, sf)
    return metrics.effect_size(gene.withColumn("score", -F.col("fc")), ["cell"], "score", "label")


@query(
    "percentile_rank_average_ties",
    f"SELECT model, target, cell, {r(pct_rank('score', 'model'), 'pct', 9)} FROM preds",
    ("preds",),
)
def percentile_rank_average_ties(spark: SparkSession, sf: str) -> DataFrame:
    out = with_rank(roles.preds(spark, sf), ["model"], "score", "pct", pct=True)
    return out.select("model", "target", "cell", rounded("pct", 9).alias("pct"))


@query(
    "within_cell_rank",
    f"""SELECT target, cell, {r(pct_rank('fc', 'cell'), 'pct', 9)} FROM gene""",
    ("gene",),
)
def within_cell_rank(spark: SparkSession, sf: str) -> DataFrame:
    out = with_rank(roles.gene(spark, sf), ["cell"], "fc", "pct", pct=True)
    return out.select("target", "cell", rounded("pct", 9).alias("pct"))


@query(
    "rank_average_ensemble",
    f"""
, ranked AS (SELECT target, cell, {pct_rank('score', 'model')} AS rk,
   CASE model WHEN 'depletion' THEN 2e0 WHEN 'hash' THEN 1e0 ELSE 3e0 END AS w FROM preds)
SELECT target, cell, count(*) AS models, {r('sum(rk * w) / sum(w)', 'score')}
FROM ranked GROUP BY target, cell""",
    ("preds",),
)
def rank_average_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    weights = {"depletion": 2.0, "hash": 1.0, "pvalue": 3.0}
    preds = roles.preds(spark, sf).drop("label")
    return round_all(ensemble.rank_average(preds, ["target", "cell"], weights), ["score"])


@query(
    "minmax_blend",
    f"""
, lim AS (SELECT model, min(score) AS lo, max(score) AS hi FROM preds GROUP BY model)
SELECT target, cell, {r('''sum((score - lo) / (hi - lo)
  * CASE model WHEN 'depletion' THEN 0.5e0 WHEN 'hash' THEN 0.25e0 ELSE 0.25e0 END)''', 'score')}
FROM preds JOIN lim USING (model) GROUP BY target, cell""",
    ("preds",),
)
def minmax_blend(spark: SparkSession, sf: str) -> DataFrame:
    weights = {"depletion": 0.5, "hash": 0.25, "pvalue": 0.25}
    preds = roles.preds(spark, sf).drop("label")
    return round_all(ensemble.minmax_blend(preds, ["target", "cell"], weights), ["score"])


@query(
    "zscore_mean_ensemble",
    f"""
, st AS (SELECT model, avg(score) AS m, stddev_pop(score) AS s FROM preds GROUP BY model)
, z AS (SELECT target, cell, avg((score - m) / (s + 1e-12)) AS z
  FROM preds JOIN st USING (model) GROUP BY target, cell)
SELECT target, cell, {r('(z - (SELECT min(z) FROM z)) / ((SELECT max(z) FROM z) - (SELECT min(z) FROM z))', 'score')}
FROM z""",
    ("preds",),
)
def zscore_mean_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    preds = roles.preds(spark, sf).drop("label")
    return round_all(ensemble.zscore_mean(preds, ["target", "cell"]), ["score"])


@query(
    "zscore_sum_composite",
    f"""
, st AS (SELECT model, avg(score) AS m, stddev_pop(score) AS s FROM preds GROUP BY model)
SELECT target, cell, {r('sum(coalesce((score - m) / nullif(s, 0), 0))', 'score')}
FROM preds JOIN st USING (model) GROUP BY target, cell""",
    ("preds",),
)
def zscore_sum_composite(spark: SparkSession, sf: str) -> DataFrame:
    preds = roles.preds(spark, sf).drop("label")
    return round_all(ensemble.zscore_sum(preds, ["target", "cell"]), ["score"])


@query(
    "fixed_rank_blends",
    f"""
, ranked AS (SELECT model, target, cell, {pct_rank('score', 'model, cell')} AS rk FROM preds)
, two AS (SELECT target, cell, max(rk) FILTER (model = 'depletion') AS a,
    max(rk) FILTER (model = 'pvalue') AS b FROM ranked GROUP BY target, cell)
SELECT target, cell, share, {r('a * share + b * (1 - share)', 'score')}
FROM two CROSS JOIN (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS share)""",
    ("preds",),
)
def fixed_rank_blends(spark: SparkSession, sf: str) -> DataFrame:
    preds = roles.preds(spark, sf).drop("label")
    out = ensemble.fixed_blends(
        preds, ["target", "cell"], "depletion", "pvalue", [0.25, 0.5, 0.75]
    )
    return round_all(out, ["score"])


@query(
    "model_coverage_problems",
    """
, holes AS (SELECT model, target, cell FROM preds WHERE NOT (model = 'hash' AND score < 0.1e0)
  UNION ALL SELECT model, target, cell FROM preds WHERE model = 'pvalue' AND score > 0.9e0)
, per AS (SELECT target, cell, model, count(*) AS n FROM holes GROUP BY ALL)
SELECT target, cell, count(*) AS models, max(n) AS copies FROM per GROUP BY target, cell
HAVING count(*) <> 3 OR max(n) > 1""",
    ("preds",),
)
def model_coverage_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that the models do not cover once each, in a frame with holes and copies put in."""
    keys = roles.preds(spark, sf).drop("label")
    hole = (F.col("model") == "hash") & (F.col("score") < 0.1)
    copied = (F.col("model") == "pvalue") & (F.col("score") > 0.9)
    times = F.when(~hole, 1).otherwise(0) + F.when(copied, 1).otherwise(0)
    rows = keys.select("model", "target", "cell", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
    return ensemble.coverage_problems(rows, ["target", "cell"], "model", 3)


# ---- submissions: every model is one, with faults put in ------------------------

_SUBS = """
, subs AS (SELECT model AS submission, target, cell,
    CASE WHEN model = 'hash' AND score < 0.05e0 THEN 'n/a'
         WHEN model = 'hash' AND score > 0.95e0 THEN 'Infinity'
         ELSE CAST(round(score, 6) AS VARCHAR) END AS score
  FROM preds WHERE NOT (model = 'pvalue' AND score < 0.02e0)
  UNION ALL SELECT model, target, cell, '0.5' FROM preds WHERE model = 'depletion' AND score > 0.02e0
  UNION ALL SELECT model, -target, cell, '0.5' FROM preds WHERE model = 'depletion' AND score < -0.02e0)
, truth AS (SELECT target, cell, label FROM gene WHERE cell <> 'RO')
, excluded AS (SELECT target, cell FROM gene WHERE cell = 'RO')
"""


def _submissions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    preds = roles.preds(spark, sf)
    model, target, score = F.col("model"), F.col("target"), F.col("score")
    text = (
        F.when((model == "hash") & (score < 0.05), "n/a")
        .when((model == "hash") & (score > 0.95), "Infinity")
        .otherwise(F.round("score", 6).cast("string"))
    )
    half = F.lit("0.5").alias("score")
    main = preds.where(~((model == "pvalue") & (score < 0.02)))
    again = preds.where((model == "depletion") & (score > 0.02))
    alien = preds.where((model == "depletion") & (score < -0.02))
    subs = (
        main.select(model.alias("submission"), "target", "cell", text.alias("score"))
        .unionAll(again.select(model.alias("submission"), "target", "cell", half))
        .unionAll(alien.select(model.alias("submission"), -target, "cell", half))
    )
    gene = roles.gene(spark, sf)
    truth = gene.where(F.col("cell") != "RO").select("target", "cell", "label")
    excluded = gene.where(F.col("cell") == "RO").select("target", "cell")
    return subs, truth, excluded


@query(
    "submission_problems",
    _SUBS
    + """
, dup AS (SELECT submission, target, cell FROM subs GROUP BY ALL HAVING count(*) > 1)
, keys AS (SELECT DISTINCT submission, target, cell FROM subs)
, lacking AS (SELECT submission, (SELECT count(*) FROM truth)
    - count(*) FILTER ((target, cell) IN (SELECT (target, cell) FROM truth)) AS n
  FROM keys GROUP BY submission)
SELECT submission, 'duplicate' AS problem, count(*) AS n FROM dup GROUP BY submission
UNION ALL SELECT submission, 'missing', n FROM lacking WHERE n > 0
UNION ALL SELECT submission, 'extra', count(*) FROM keys
  WHERE (target, cell) NOT IN (SELECT (target, cell) FROM gene) GROUP BY submission
UNION ALL SELECT submission, 'not a finite number', count(*) FROM subs
  WHERE try_cast(score AS DOUBLE) IS NULL OR NOT isfinite(try_cast(score AS DOUBLE))
  GROUP BY submission""",
    ("preds", "gene"),
)
def submission_problems(spark: SparkSession, sf: str) -> DataFrame:
    subs, truth, excluded = _submissions(spark, sf)
    return board.problem_list(subs, truth, excluded, "submission", ["target", "cell"], "score")


_META = """
, meta AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN '-' || s_name ELSE 'user-' || s_suppkey END AS submitter,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'm' END AS model,
    CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE 'maybe' END AS uses_measured_depletion FROM supplier)
"""


@query(
    "metadata_problem_rows",
    _META
    + """SELECT s_suppkey, list_filter([
    CASE WHEN submitter IS NULL THEN 'missing field submitter' END, CASE WHEN model IS NULL THEN 'missing field model' END,
    CASE WHEN uses_measured_depletion IS NULL THEN 'missing field uses_measured_depletion' END,
    CASE WHEN submitter LIKE '-%' THEN 'bad handle ' || submitter END,
    CASE WHEN uses_measured_depletion = 'maybe' THEN 'uses_measured_depletion must be true or false' END],
  lambda x: x IS NOT NULL) AS problems FROM meta""",
)
def metadata_problem_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each submission's metadata."""
    key = F.col("s_suppkey")
    name = F.when(key % 5 == 0, None).when(key % 3 == 0, F.concat(F.lit("-"), "s_name"))
    meta = roles.table(spark, sf, "supplier").select(
        "s_suppkey",
        name.otherwise(F.concat(F.lit("user-"), key)).alias("submitter"),
        F.when(key % 7 != 0, F.lit("m")).alias("model"),
        F.when(key % 4 == 1, "true").when(key % 4 == 2, "false").when(key % 4 == 3, "maybe").alias("uses_measured_depletion"),
    )
    return board.metadata_problem_rows(meta).select("s_suppkey", "problems")


@query(
    "submission_duplicates",
    _SUBS
    + "SELECT submission, target, cell, count(*) AS copies FROM subs GROUP BY ALL HAVING count(*) > 1",
    ("preds", "gene"),
)
def submission_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return board.duplicate_keys(_submissions(spark, sf)[0], "submission", ["target", "cell"])


@query(
    "submission_extra_keys",
    _SUBS
    + """SELECT DISTINCT submission, target, cell FROM subs
  WHERE (target, cell) NOT IN (SELECT (target, cell) FROM gene)""",
    ("preds", "gene"),
)
def submission_extra_keys(spark: SparkSession, sf: str) -> DataFrame:
    subs, truth, excluded = _submissions(spark, sf)
    return board.extra_keys(subs, truth, excluded, "submission", ["target", "cell"])


@query(
    "submission_missing_keys",
    _SUBS
    + """
, keys AS (SELECT DISTINCT submission, target, cell FROM subs)
SELECT submission, (SELECT count(*) FROM truth)
    - count(*) FILTER ((target, cell) IN (SELECT (target, cell) FROM truth)) AS missing
  FROM keys GROUP BY submission""",
    ("preds", "gene"),
)
def submission_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    subs, truth, _ = _submissions(spark, sf)
    return board.missing_keys(subs, truth, "submission", ["target", "cell"])


@query(
    "submission_bad_scores",
    _SUBS
    + """SELECT submission, count(*) AS n, count(*) FILTER (try_cast(score AS DOUBLE) IS NULL
    OR NOT isfinite(try_cast(score AS DOUBLE))) AS bad FROM subs GROUP BY submission""",
    ("preds", "gene"),
)
def submission_bad_scores(spark: SparkSession, sf: str) -> DataFrame:
    subs = _submissions(spark, sf)[0]
    return subs.groupBy("submission").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(board.bad_score("score")).alias("bad")
    )


_BOARD = (
    """
, truth AS (SELECT target, cell, label FROM gene)
, rows AS (SELECT model AS submission, target, cell, round(score, 6) AS score, truth.label
  FROM preds JOIN truth USING (target, cell))
"""
    + ap_auroc("rows", "submission")
)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    preds = roles.preds(spark, sf).select(
        F.col("model").alias("submission"), "target", "cell", F.round("score", 6).alias("score")
    )
    truth = roles.gene(spark, sf).select("target", "cell", "label")
    return board.score_all(preds, truth, "submission", ["target", "cell"], "score", "label")


@query(
    "submission_scores",
    _BOARD
    + f"""SELECT submission, n, n_pos, {r('auroc', 'auroc')}, {r('auprc', 'auprc')},
  {r('n_pos / n', 'base_rate')}, {r('auprc / (n_pos / n)', 'lift')} FROM ap_out""",
    ("preds", "gene"),
)
def submission_scores(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(_scores(spark, sf), ["auroc", "auprc", "base_rate", "lift"])


@query(
    "leaderboard",
    _BOARD
    + f"""SELECT submission, submission <> 'pvalue' AS eligible, {r('auprc', 'auprc')},
  CASE WHEN submission <> 'pvalue' THEN CAST(row_number() OVER (PARTITION BY submission <> 'pvalue'
    ORDER BY auprc DESC, submission) AS INT) END AS place FROM ap_out""",
    ("preds", "gene"),
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf).withColumn("eligible", F.col("submission") != "pvalue")
    out = board.leaderboard(scores, "submission", "eligible")
    return round_all(out.select("submission", "eligible", "auprc", "place"), ["auprc"])


@query(
    "handle_validity",
    """SELECT c_name, regexp_full_match(replace(c_name, '#', '-'),
   '[A-Za-z0-9]([A-Za-z0-9]|-[A-Za-z0-9])*') AND length(c_name) <= 39 AS ok,
   regexp_full_match(c_mktsegment || '-', '[A-Za-z0-9]([A-Za-z0-9]|-[A-Za-z0-9])*') AS ok_segment
   FROM customer""",
)
def handle_validity(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "customer").select(
        "c_name",
        board.valid_handle(F.regexp_replace("c_name", "#", "-")).alias("ok"),
        board.valid_handle(F.concat("c_mktsegment", F.lit("-"))).alias("ok_segment"),
    )


@query(
    "quantile_clip_sweep",
    f"""
, q AS (SELECT unnest([0.9e0, 0.95e0, 0.99e0, 1e0]) AS q)
, lim AS (SELECT q, greatest(0.01e0, CASE
     WHEN q = 0.9e0 THEN (SELECT quantile_cont(abs(fc), 0.9) FROM gene)
     WHEN q = 0.95e0 THEN (SELECT quantile_cont(abs(fc), 0.95) FROM gene)
     WHEN q = 0.99e0 THEN (SELECT quantile_cont(abs(fc), 0.99) FROM gene)
     ELSE (SELECT max(abs(fc)) FROM gene) END) AS lim FROM q)
SELECT q, {r('lim', 'clip_limit', 9)}, count(*) FILTER (abs(fc) > lim + 1e-12) AS clipped,
  {r('count(*) FILTER (abs(fc) > lim + 1e-12) / count(*)', 'pct_clipped')}
FROM gene CROSS JOIN lim GROUP BY q, lim""",
    ("gene",),
)
def quantile_clip_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Clip limit and clipped share for several quantiles of |fc|."""
    size = roles.gene(spark, sf).select(F.abs("fc").alias("size"))
    qs = {"q90": 0.9, "q95": 0.95, "q99": 0.99, "q100": 1.0}
    limits = quantiles(size, [], "size", qs)
    one = limits.select(F.struct(*qs).alias("l")).scalar()
    rows = size.select("size", one.alias("l"))
    per = F.array(
        *[
            F.struct(
                F.lit(q).cast("double").alias("q"),
                F.greatest(F.lit(0.01), F.col(f"l.{name}")).alias("lim"),
            )
            for name, q in qs.items()
        ]
    )
    return (
        rows.select("size", F.explode(per).alias("x"))
        .groupBy(F.col("x.q").alias("q"), F.col("x.lim").alias("clip_limit"))
        .agg(
            F.count_if(F.col("size") > F.col("x.lim") + 1e-12).alias("clipped"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "q",
            rounded("clip_limit", 9).alias("clip_limit"),
            "clipped",
            rounded(F.col("clipped") / F.col("n")).alias("pct_clipped"),
        )
    )


@query("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Score report of every submission: interval, lift over the base rate, smallest gap."""
    rows = roles.preds(spark, sf).withColumnRenamed("model", "submission")
    return bootstrap.ap_interval(rows, ["submission"], "score", "label")
