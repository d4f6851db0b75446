"""Model queries.  Features are other cells' outcomes of the same target, so the
held-out cell never informs its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators import gene_runs, models, pipeline, screen, tree_search
from screenlab.operators.metrics import ranking_metrics, regression_metrics
from screenlab.plans import roles
from screenlab.plans.registry import query, rounded
from screenlab.plans.sqltext import r
from screenlab.session import cut_lineage, shared_folder, written

HELD = "RF"
NAMES = [f"{o}_{s}" for o in screen.OUTCOMES for s in ("mean", "max", "min", "std")]
KEYS = ["target", "cell"]
#: Trials of a search; the reference's default.
TRIALS = 50
#: Settings of boosted regression (fixed values but for `rounds` and `rate`).
HUBER = {"rounds": 20, "rate": 0.1, "depth": 3, "least": 3.0, "row_share": 0.8, "column_share": 0.8, "threshold": 1.0, "penalty": 1.0}


def _design(spark: SparkSession, sf: str, held: str = HELD) -> DataFrame:
    """Features, outcomes and a unit weight; kept, since every fit passes over it many times."""
    rows = screen.with_outcomes(roles.gene(spark, sf)).withColumn("weight", F.lit(1.0))
    feats = screen.cross_cell_priors(roles.gene(spark, sf), held)
    parts = 2 * spark.sparkContext.defaultParallelism
    return models.assembled(rows.join(feats, KEYS), NAMES).coalesce(parts).persist()


def _parts(design: DataFrame, held: str = HELD) -> tuple[DataFrame, DataFrame]:
    train = models.weighted(design.where(F.col("cell") != held).drop("weight"))
    return train, design.where(F.col("cell") == held)


def _scored(out: DataFrame, name: str) -> DataFrame:
    m = ranking_metrics(cut_lineage(out.select("label", "score")), [], "score", "label")
    return m.select(F.lit(name).alias("model"), "n", "n_pos", "auroc", "auprc")


@query(
    "base_rate_model",
    f"""SELECT target, cell, {r("(SELECT avg(label) FROM gene WHERE cell <> 'RF')", 'score')},
  {r("(SELECT avg(fc) FROM gene WHERE cell <> 'RF')", 'mean_fc')} FROM gene WHERE cell = 'RF'""",
    ("gene",),
)
def base_rate_model(spark: SparkSession, sf: str) -> DataFrame:
    """The training rows' base rate, and their mean fold change, for every held-out row."""
    gene = roles.gene(spark, sf)
    train, test = gene.where(F.col("cell") != HELD), gene.where(F.col("cell") == HELD)
    rate = models.base_rate_model(train, test, KEYS)
    mean = models.base_rate_model(train, test, KEYS, "fc")
    both = rate.join(mean.withColumnRenamed("score", "mean_fc"), KEYS)
    return both.select(*KEYS, rounded("score").alias("score"), rounded("mean_fc").alias("mean_fc"))


@query("model_comparison")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered classifier, weighted, on the held-out cell."""
    train, test = _parts(_design(spark, sf))
    settings = {
        "logreg": {},
        "boosted_trees": {"maxIter": 5},
        "random_forest": {"numTrees": 10},
        "decision_tree": {},
        "linear_svm": {"maxIter": 20},
        "gaussian_nb": {},
    }
    out = None
    for name, params in settings.items():
        part = models.fit_predict(name, train, test, ["label"], **params)
        part = part.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return ranking_metrics(cut_lineage(out), ["model"], "score", "label")


@query("kernel_svm")
def kernel_svm(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(_design(spark, sf))
    return _scored(models.kernel_svm(train, test, [*KEYS, "label"], 100, maxIter=20), "kernel_svm")


@query("neural_net_resampled")
def neural_net_resampled(spark: SparkSession, sf: str) -> DataFrame:
    """The network takes no weights, so its training rows are balanced by repetition."""
    train, test = _parts(_design(spark, sf))
    rows = models.balanced_rows(train, KEYS, "random_over")
    out = models.fit_predict("neural_net", rows, test, [*KEYS, "label"], inputs=len(NAMES), hidden=8, maxIter=20)
    return _scored(out, "neural_net")


@query("balanced_bagging")
def balanced_bagging(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(_design(spark, sf))
    keyed = train.withColumn("k", models.shuffled_key(train, KEYS))
    out = models.balanced_bagging(keyed, test, "k", [*KEYS, "label"], estimators=5)
    return _scored(out, "balanced_bagging")


@query("early_stopped_trees")
def early_stopped_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Boosting that watches one training cell to stop."""
    train, test = _parts(_design(spark, sf))
    watched = train.withColumn("watch", F.col("cell") == "RO")
    settings = dict(rounds=20, depth=3, rate=0.3, patience=3)
    out = models.fit_predict("histogram_trees", watched, test, [*KEYS, "label"], early_stop="watch", **settings)
    return _scored(out, "early_stopped_trees")


@query("alpha_sweep")
def alpha_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge and lasso on the fold change, by mean Spearman over held-out cells."""
    design = _design(spark, sf)
    rows = design.where(F.col("cell") != HELD).withColumn("label", F.col("fc"))
    cells = [c for c in roles.CELLS if c != HELD]
    out = None
    for name, alphas in {"ridge": [1.0, 100.0], "lasso": [0.0001, 0.001]}.items():
        trials = models.grid({"alpha": alphas})
        found = models.search(rows, "cell", cells, name, trials, "spearman_rho")
        found = found.select(F.lit(name).alias("model"), "params", "score", "folds")
        out = found if out is None else out.unionByName(found)
    return out


@query("boosted_regression")
def boosted_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Depletion under pseudo-Huber loss, with the reference's settings but for the number of trees."""
    train, test = _parts(_design(spark, sf))
    rows = train.withColumn("label", F.col("depletion"))
    out = models.fit_predict("boosted_regression", rows, test, [*KEYS, "depletion"], **HUBER)
    return regression_metrics(out, ["cell"], "depletion", "score")


@query("grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Tree depth by mean AUPRC over the training cells; the held-out cell takes no part."""
    train, _ = _parts(_design(spark, sf))
    cells = [c for c in roles.CELLS if c != HELD]
    return models.search(train, "cell", cells, "decision_tree", models.grid({"maxDepth": [2, 4]}))


@query("nested_random_search")
def nested_random_search(spark: SparkSession, sf: str, n_trials: int = TRIALS) -> DataFrame:
    """Per outer cell: random search over all its training cells, then one prediction per row.

    `n_trials` settings are drawn once and judged on each inner cell. All trees of
    all cells and settings are grown together, a pass over the rows a level.
    """
    space = {"maxDepth": ("int", 2, 5), "minInstancesPerNode": ("int", 1, 50, "log")}
    trials = models.draws(space, n_trials, seed=1)
    design = screen.cross_cell_designs(roles.gene(spark, sf), roles.CELLS)
    out, best = tree_search.nested_search(design, "outer", "cell", roles.CELLS, trials, [*KEYS, "label"])
    table = spark.createDataFrame([(o, repr(t)) for o, (t, _) in best.items()], "outer string, params string")
    checked = models.require_once(written(out.join(table, "outer")), KEYS)
    return ranking_metrics(checked, ["cell", "params"], "score", "label")


@query("out_of_fold_predictions")
def out_of_fold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell predicted by a model fitted on the others: one score per row."""
    out = None
    for cell in roles.CELLS:
        train, test = _parts(_design(spark, sf, cell), cell)
        part = models.fit_predict("decision_tree", train, test, [*KEYS, "label"], maxDepth=3)
        out = part if out is None else out.unionByName(part)
    checked = models.require_once(cut_lineage(out), KEYS)
    return ranking_metrics(checked, ["cell"], "score", "label")


@query("drop_one_source_average")
def drop_one_source_average(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows scored once per dropped source cell, and averaged.

    The statistics without one source are the leave-one-out rows of the training
    cells, so all drops come from one pass.
    """
    design = _design(spark, sf)
    train, _ = _parts(design)
    model = models.build("boosted_trees", maxIter=5).fit(train)
    rows = screen.with_outcomes(roles.gene(spark, sf))
    dropped = screen.leave_one_out(rows.where(F.col("cell") != HELD), "target", "cell", screen.OUTCOMES)
    held = rows.where(F.col("cell") == HELD).select("target", "label")
    each = dropped.select("target", F.col("cell").alias("dropped"), *NAMES).join(held, "target")
    scores = models.predicted(model, models.assembled(each, NAMES), ["target", "label", "dropped"])
    mean = scores.groupBy("target", "label").agg(F.avg("score").alias("score"))
    return _scored(mean, "drop_one_source")


@query("pooled_and_own_models")
def pooled_and_own_models(spark: SparkSession, sf: str) -> DataFrame:
    """One model for all cells against one per cell, on held-out chromosomes."""
    design = _design(spark, sf)
    test_rows = F.col("chrom").isin("1", "2", "3", "4", "5")
    train = models.weighted(design.where(~test_rows).drop("weight"))
    test = design.where(test_rows)
    pooled = models.fit_predict("decision_tree", train, test, [*KEYS, "label"], maxDepth=3)
    own = models.per_group(train, test, "cell", roles.CELLS, [*KEYS, "label"], "decision_tree", maxDepth=3)
    both = pooled.withColumn("kind", F.lit("pooled")).unionByName(own.withColumn("kind", F.lit("own")))
    return ranking_metrics(cut_lineage(both), ["kind", "cell"], "score", "label")


@query("gene_propensity")
def gene_propensity(spark: SparkSession, sf: str) -> DataFrame:
    """A target-level regression on the training cells, read back on every held-out row."""
    rows = screen.with_outcomes(roles.gene(spark, sf))
    feats = screen.cross_cell_priors(roles.gene(spark, sf), HELD)
    train = rows.where(F.col("cell") != HELD).join(feats, KEYS)
    held = rows.where(F.col("cell") == HELD).select("target", "label")
    out = models.gene_propensity(train, held, NAMES, "strength", **HUBER)
    return _scored(out.withColumnRenamed("propensity", "score"), "gene_propensity")


def _sequence_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(target, cell, chrom, label, distance) of targets with a body, and the bodies."""
    notes = roles.table(spark, sf, "part").select(
        F.col("p_partkey").alias("target"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("distance")
    )
    bodies = roles.seqs(spark, sf).where(F.length("seq") >= 2)
    rows = roles.gene(spark, sf).select(*KEYS, "chrom", "label").join(notes, "target")
    # Written, as every fold and fit reads the rows.
    return cut_lineage(rows.join(bodies.select("target"), "target", "left_semi")), bodies


@query("configured_run")
def configured_run(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run from its configuration: features of each fold from sequences, grid, fit, score by cell."""
    rows, bodies = _sequence_rows(spark, sf)
    config = pipeline.Config(
        model="decision_tree",
        cv="stratified",
        stratified_k=5,
        tuning="grid",
        space={"maxDepth": [2, 4]},
        class_weight="balanced",
        resampling="random_under",
    )
    train, test = rows.where(F.col("cell") != HELD), rows.where(F.col("cell") == HELD)
    return gene_runs.run_from_sequences(config, train, test, bodies, 2, roles.CELLS).metrics


@query(
    "saved_model_scores",
    """, b AS (SELECT target FROM seqs WHERE length(seq) >= 2)
, x AS (SELECT cell, count(*) AS rows FROM gene JOIN part ON p_partkey = target SEMI JOIN b USING (target) GROUP BY cell)
SELECT cell, rows, rows AS same_in_batch, TRUE AS same_alone FROM x""",
    ("gene", "seqs"),
)
def saved_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A model saved and read again: rows it scores as before, and whether one sequence alone scores so too."""
    rows, bodies = _sequence_rows(spark, sf)
    counted = gene_runs.counted_bodies(bodies, 2)
    own = gene_runs.GeneFeatures.fit(rows, counted, 2, roles.CELLS)
    design = models.weighted(own.design(rows, counted))
    model = models.build("histogram_trees", rounds=5, rate=0.3).fit(design)
    folder = f"{shared_folder(spark)}/model"
    gene_runs.SavedModel(own, model).save(spark, folder)
    read = gene_runs.SavedModel.load(spark, folder)
    before = models.predicted(model, design, KEYS)
    after = read.score(rows, counted).withColumnRenamed("score", "again")
    one = rows.orderBy("target", "cell").select(*KEYS, "distance").first()
    text = bodies.where(F.col("target") == one.target).first().seq
    alone = read.score_one(spark, text, [one.cell], one.distance).select(F.col("score").alias("alone"))
    mine = cut_lineage(before.join(after, KEYS))
    want = mine.where((F.col("target") == one.target) & (F.col("cell") == one.cell)).select("score").scalar()
    same = alone.select((F.abs(F.col("alone") - want) < 1e-12).alias("s")).scalar()
    return mine.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") == F.col("again")).alias("same_in_batch")
    ).select("*", same.alias("same_alone"))
