"""A configured run: validate, split, tune, fit, predict, score."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlab.operators import folds, metrics, models, resample
from screenlab.session import cut_lineage
from screenlab.sources.records import write_run

# What a configuration may name.
CV = ("none", "chromosome", "stratified", "cellline")
TUNING = ("none", "grid", "random")
METRICS = ("auroc", "auprc")


@dataclass
class Config:
    model: str
    params: dict = field(default_factory=dict)
    cv: str = "none"
    tuning: str = "none"
    space: Mapping | None = None
    trials: int = 10
    metric: str = "auprc"
    resampling: str = "none"
    class_weight: str = "one"
    minimum_fold: int = 500
    stratified_k: int = 5
    seed: int = 0


def validate(config: Config) -> Config:
    problems = []
    if config.model not in models.REGISTRY:
        problems.append(f"unknown model {config.model!r}")
    for name, value, allowed in (
        ("cv", config.cv, CV),
        ("tuning", config.tuning, TUNING),
        ("metric", config.metric, METRICS),
        ("resampling", config.resampling, tuple(resample.METHODS)),
    ):
        if value not in allowed:
            problems.append(f"{name} must be one of {list(allowed)}, not {value!r}")
    if config.tuning != "none" and config.cv == "none":
        problems.append("tuning needs cross-validation")
    if config.tuning != "none" and not config.space:
        problems.append("tuning needs a search space")
    if problems:
        raise ValueError("; ".join(problems))
    return config


def with_fold(train: DataFrame, config: Config) -> tuple[DataFrame, list[str]]:
    """Training rows with ``fold`` and the names of the folds that are held out in turn."""
    if config.cv == "stratified":
        keyed = train.withColumn("_k", models.shuffled_key(train, ["target", "cell"], config.seed))
        out = folds.stratified_folds(keyed, "label", "_k", config.stratified_k).drop("_k")
        return out.withColumn("fold", F.col("fold").cast("string")), [
            str(i) for i in range(config.stratified_k)
        ]
    column = "chrom" if config.cv == "chromosome" else "cell"
    minimum = config.minimum_fold if config.cv == "chromosome" else 1
    table = folds.group_folds(train, column, minimum).select("fold").toLocalIterator()
    return train.withColumn("fold", F.col(column)), [r.fold for r in table]


@dataclass
class Run:
    params: dict
    cv: DataFrame | None
    predictions: DataFrame
    metrics: DataFrame | None


def run(config: Config, train: DataFrame, test: DataFrame) -> Run:
    """train/test: target, cell, chrom, label, features.  A test frame whose labels
    are missing is predicted and not scored."""
    validate(config)
    train = models.weighted(train, config.class_weight)
    params, cv = dict(config.params), None
    if config.cv != "none":
        design, held = with_fold(train, config)
        trials = [params]
        if config.tuning == "grid":
            trials = [{**params, **t} for t in models.grid(config.space)]
        elif config.tuning == "random":
            trials = [{**params, **t} for t in models.draws(config.space, config.trials, config.seed)]
        balanced = None
        if config.resampling != "none":
            def balanced(rows: DataFrame) -> DataFrame:
                return models.balanced_rows(rows, ["target", "cell"], config.resampling, config.seed)

        cv = models.search(design, "fold", held, config.model, trials, config.metric, prepare=balanced)
        params = models.best_params(cv, trials)
    rows = models.balanced_rows(train, ["target", "cell"], config.resampling, config.seed)
    out = cut_lineage(
        models.fit_predict(config.model, rows, test, ["target", "cell", "label"], **params)
    )
    labelled = test.where(F.col("label").isNull() | (F.col("label") < 0)).isEmpty()
    if not labelled:
        return Run(params, cv, out.drop("label"), None)
    scored = metrics.ranking_metrics_by_sets(out, [[], ["cell"]], "score", "label")
    return Run(params, cv, out, scored)


def save(done: Run, folder: str, run_id: str) -> None:
    """Write a run's tables; an unlabelled run has an empty metrics table."""
    spark = done.predictions.sparkSession
    info = spark.createDataFrame([(repr(done.params),)], "params string")
    empty = spark.createDataFrame([], "split string, n long")
    write_run(
        folder,
        run_id,
        done.metrics if done.metrics is not None else empty,
        done.cv if done.cv is not None else spark.createDataFrame([], "trial int, score double"),
        info,
        done.predictions,
    )
