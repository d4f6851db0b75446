"""Models by name, fitting and prediction, on MLlib.

A design frame has its key columns, ``features`` (vector), ``label`` and
``weight``.  Predictions carry ``score``: a probability, or a regressor's value.
"""

from __future__ import annotations

import inspect
import random
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.functions import maths as fm
from screenlab.operators import resample
from screenlab.operators.boosting import Boosting, Settings
from screenlab.operators.metrics import metric as metric_by_name
from screenlab.operators.metrics import ranking_metrics
from screenlab.session import cut_lineage

Factory = Callable[..., Estimator]
REGISTRY: dict[str, Factory] = {}


def register(name: str) -> Callable[[Factory], Factory]:
    def add(factory: Factory) -> Factory:
        if name in REGISTRY:
            raise ValueError(f"model {name!r} is already registered")
        REGISTRY[name] = factory
        return factory

    return add


def names() -> list[str]:
    return sorted(REGISTRY)


def build(name: str, **params) -> Estimator:
    if name not in REGISTRY:
        raise KeyError(f"unknown model {name!r}, have {names()}")
    return REGISTRY[name](**params)


def _scaled(estimator: Estimator) -> Pipeline:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, estimator.setFeaturesCol("scaled")])


@register("logreg")
def _logreg(C: float = 1.0, total_weight: float = 1000.0, maxIter: int = 50) -> Estimator:
    """L2 penalty of 1 / (C total weight), as in the summed-loss form; fits take the weight from their rows."""
    return _scaled(
        mc.LogisticRegression(
            regParam=1.0 / (C * total_weight),
            elasticNetParam=0.0,
            weightCol="weight",
            maxIter=maxIter,
            standardization=False,
        )
    )


@register("boosted_trees")
def _boosted(maxIter: int = 20, maxDepth: int = 3, stepSize: float = 0.1, seed: int = 0, early_stop: str | None = None, **kw) -> Estimator:
    model = mc.GBTClassifier(
        maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, weightCol="weight", seed=seed, **kw
    )
    if early_stop is not None:
        model = model.setValidationIndicatorCol(early_stop)
    return model


@register("random_forest")
def _forest(numTrees: int = 20, maxDepth: int = 5, seed: int = 0) -> Estimator:
    return mc.RandomForestClassifier(
        numTrees=numTrees, maxDepth=maxDepth, weightCol="weight", seed=seed
    )


@register("decision_tree")
def _tree(maxDepth: int = 5, minInstancesPerNode: int = 1, seed: int = 0) -> Estimator:
    return mc.DecisionTreeClassifier(
        maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, weightCol="weight", seed=seed
    )


@register("linear_svm")
def _svm(regParam: float = 0.01, maxIter: int = 50) -> Estimator:
    return _scaled(mc.LinearSVC(regParam=regParam, maxIter=maxIter, weightCol="weight"))


@register("gaussian_nb")
def _nb() -> Estimator:
    return mc.NaiveBayes(modelType="gaussian", weightCol="weight")


@register("neural_net")
def _net(inputs: int, hidden: int = 16, maxIter: int = 50, seed: int = 0) -> Estimator:
    """One hidden layer.  It takes no weights: balance the rows by resampling."""
    return _scaled(
        mc.MultilayerPerceptronClassifier(layers=[inputs, hidden, 2], maxIter=maxIter, seed=seed)
    )


@register("ridge")
def _ridge(alpha: float = 1.0, rows: int = 1000, spread: float = 1.0) -> Estimator:
    """Squared errors summed plus alpha times the squared norm.

    The estimator divides its penalty by the spread of the outcome; fits take
    both numbers from their rows.
    """
    return mr.LinearRegression(regParam=alpha * spread / rows, elasticNetParam=0.0, standardization=False)


@register("lasso")
def _lasso(alpha: float = 0.01) -> Estimator:
    return mr.LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False)


@register("boosted_regression")
def _boosted_regression(loss: str = "pseudo_huber", early_stop: str | None = None, **settings) -> Boosting:
    """Trees from grouped histograms; the settings are those of `boosting.Settings`."""
    return Boosting(Settings(loss, **settings), watch=early_stop)


@register("histogram_trees")
def _histogram_trees(early_stop: str | None = None, **settings) -> Boosting:
    return Boosting(Settings("logistic", **settings), watch=early_stop)


def weighted(df: DataFrame, scheme: str = "balanced", multiplier: float = 1.0) -> DataFrame:
    """``weight``: 1 for negatives, the class-weight scheme's value for positives."""
    table = resample.class_weights(df, "label", multiplier)
    value = table.where(F.col("scheme") == scheme).select("weight").scalar()
    return df.withColumn("weight", value).withColumn(
        "weight", F.when(F.col("label") == 1, F.col("weight")).otherwise(F.lit(1.0))
    )


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = df.fillna(0.0, subset=list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled)


def predicted(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``score``: P(positive), a squashed margin, or the value."""
    out = model.transform(df)
    if "probability" in out.columns:
        score: Column = F.get(vector_to_array("probability"), F.lit(1))
    elif "rawPrediction" in out.columns:
        score = fm.sigmoid(F.get(vector_to_array("rawPrediction"), F.lit(1)))
    else:
        score = F.col("prediction")
    return out.select(*keep, score.alias("score"))


def fit_predict(
    name: str, train: DataFrame, test: DataFrame, keep: Sequence[str], **params
) -> DataFrame:
    return predicted(build(name, **{**sized(name, train), **params}).fit(train), test, keep)


def sized(name: str, train: DataFrame) -> dict:
    """The parameters of a penalised model that follow from its training rows."""
    wanted = inspect.signature(REGISTRY[name]).parameters if name in REGISTRY else {}
    if "rows" in wanted:
        n, spread = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        return {"rows": max(1, n), "spread": spread or 1.0}
    if "total_weight" in wanted:
        return {"total_weight": train.agg(F.sum("weight")).first()[0] or 1.0}
    return {}


def base_rate_model(train: DataFrame, test: DataFrame, keep: Sequence[str], label: str = "label") -> DataFrame:
    """The training mean of the label for every row (base rate, or mean predictor)."""
    mean = train.agg(F.avg(F.col(label).cast("double")).alias("m")).scalar()
    return test.select(*keep, mean.alias("score"))


# ---- kernel approximation ------------------------------------------------------------


class Nystroem:
    """RBF features from landmark rows.

    The landmarks (``size`` x dimensions) and their whitening matrix
    (``size`` x ``size``) are bounded by the parameter and go to every task.
    """

    def __init__(self, size: int = 100, gamma: float | None = None, seed: int = 0):
        self.size, self.gamma, self.seed = size, gamma, seed
        self.landmarks: np.ndarray | None = None
        self.whiten: np.ndarray | None = None

    def fit(self, df: DataFrame) -> Nystroem:
        keys = df.select("features", F.xxhash64(vector_to_array("features"), F.lit(self.seed)).alias("h"))
        rows = keys.orderBy("h").limit(self.size).select(vector_to_array("features").alias("v")).collect()
        self.landmarks = np.unique(np.array([r.v for r in rows], dtype=float), axis=0)
        if self.gamma is None:
            self.gamma = 1.0 / self.landmarks.shape[1]
        values, vectors = np.linalg.eigh(self._kernel(self.landmarks))
        kept = values > 1e-10
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])
        return self

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        base = self.landmarks
        squares = (x * x).sum(1)[:, None] + (base * base).sum(1)[None, :] - 2.0 * x @ base.T
        return np.exp(-self.gamma * np.maximum(squares, 0.0))

    def transform(self, df: DataFrame) -> DataFrame:
        def kernel_features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                if len(rows):
                    x = np.stack([np.asarray(v, dtype=float) for v in rows])
                    yield pd.Series(list(self._kernel(x) @ self.whiten))
                else:
                    yield pd.Series([], dtype=object)

        from pyspark.sql.functions import pandas_udf

        udf = pandas_udf(kernel_features, "array<double>")
        return df.withColumn("features", array_to_vector(udf(vector_to_array("features"))))


def kernel_svm(train: DataFrame, test: DataFrame, keep: Sequence[str], size: int = 100, **params) -> DataFrame:
    """Scaling, landmark kernel features, linear SVM, squashed margin."""
    scaler = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(train)

    def scaled(df: DataFrame) -> DataFrame:
        return scaler.transform(df).drop("features").withColumnRenamed("_s", "features")

    kernel = Nystroem(size).fit(scaled(train))
    return fit_predict("linear_svm", kernel.transform(scaled(train)), kernel.transform(scaled(test)), keep, **params)


# ---- bagging ---------------------------------------------------------------------------


def balanced_bagging(
    train: DataFrame, test: DataFrame, key: str, keep: Sequence[str], estimators: int = 5, ratio: float = 1.0, seed: int = 0, **params
) -> DataFrame:
    """Mean probability of trees fitted on all positives and equally many negatives."""
    samples = resample.bagging_samples(train, "label", key, estimators, ratio, seed)
    votes = None
    for i in range(estimators):
        part = samples.where(F.col("estimator") == i).withColumn("weight", F.lit(1.0))
        one = fit_predict("decision_tree", part, test, keep, seed=seed + i, **params)
        votes = one if votes is None else votes.unionByName(one)
    return cut_lineage(votes).groupBy(*keep).agg(F.avg("score").alias("score"))


# ---- search ------------------------------------------------------------------------------


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values."""
    return [dict(zip(space, values, strict=True)) for values in product(*space.values())]


def draws(space: Mapping[str, tuple], trials: int, seed: int = 0) -> list[dict]:
    """Seeded random trials from {name: ("float"|"int", lo, hi[, "log"]) | ("cat", values)}."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        trial = {}
        for name, spec in space.items():
            kind = spec[0]
            if kind == "cat":
                trial[name] = rng.choice(list(spec[1]))
                continue
            if kind not in ("float", "int"):
                raise ValueError(f"unknown kind {kind!r} for {name}")
            lo, hi = float(spec[1]), float(spec[2])
            if len(spec) > 3 and spec[3] == "log":
                value = float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
            else:
                value = rng.uniform(lo, hi)
            trial[name] = round(value) if kind == "int" else value
        out.append(trial)
    return out


def search(
    design: DataFrame,
    fold: str,
    folds: Iterable,
    name: str,
    trials: Sequence[dict],
    metric: str = "auprc",
    label: str = "label",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    parts: Callable[[str], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """(trial, params, score, folds): mean fold metric per trial, best first.

    Each fit is a job, and the plan is cut after each trial; all predictions are
    then scored in one grouped pass. ``prepare`` gets the training rows of a fold
    (to balance them, say), never the rows it is judged on; ``parts`` gives both
    kinds of rows of a fold, where each has features of its own.
    """
    scored = None
    folds = list(folds)
    prepared = {f: cut_lineage(prepare(design.where(F.col(fold) != f))) for f in folds} if prepare else {}
    for t, params in enumerate(trials):
        own = None
        for f in folds:
            train, valid = parts(f) if parts else (design.where(F.col(fold) != f), design.where(F.col(fold) == f))
            out = fit_predict(name, prepared.get(f, train), valid, [label], **params)
            out = out.select(F.lit(t).alias("trial"), F.lit(str(f)).alias("fold"), F.col(label).alias("label"), "score")
            own = out if own is None else own.unionByName(out)
        own = cut_lineage(own)
        scored = own if scored is None else scored.unionByName(own)
    per = metric_by_name(scored, metric, ["trial", "fold"], "score", "label")
    text = design.sparkSession.createDataFrame(
        [(t, repr(p)) for t, p in enumerate(trials)], "trial int, params string"
    )
    mean = per.groupBy("trial").agg(F.avg("value").alias("score"), F.count("value").alias("folds"))
    return mean.join(text, "trial").orderBy(F.desc("score"), "trial")


def best_params(found: DataFrame, trials: Sequence[dict]) -> dict:
    """Parameters of the top row of ``search`` (one row is fetched)."""
    return trials[found.first().trial]


def out_of_fold(
    design: DataFrame, fold: str, folds: Iterable, keep: Sequence[str], fit_one: Callable[[DataFrame, DataFrame, str], DataFrame]
) -> DataFrame:
    """Predictions of every row by the model that did not see its fold."""
    out = None
    for f in folds:
        part = fit_one(design.where(F.col(fold) != f), design.where(F.col(fold) == f), str(f))
        part = part.select(*keep, "score", F.lit(str(f)).alias("held_out"))
        out = part if out is None else out.unionByName(part)
    return cut_lineage(out)


def require_once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error when a key is predicted more than once."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).take(3)
    if twice:
        raise ValueError(f"rows predicted more than once, e.g. {twice}")
    return df


def per_group(
    design: DataFrame, test: DataFrame, group: str, values: Iterable, keep: Sequence[str], name: str, **params
) -> DataFrame:
    """A model of its own per group value."""
    out = None
    for v in values:
        here = F.col(group) == v
        part = fit_predict(name, design.where(here), test.where(here), keep, **params)
        out = part if out is None else out.unionByName(part)
    return out


def gene_propensity(
    train: DataFrame, rows: DataFrame, columns: Sequence[str], outcome: str, name: str = "boosted_regression", **params
) -> DataFrame:
    """A target-level model: rows collapsed to target means, fitted, and joined back.

    ``train`` has target, ``columns``, ``outcome``; a target never trained on gets 0.
    """
    means = [F.avg(c).alias(c) for c in columns]
    per = train.groupBy("target").agg(*means, F.avg(F.col(outcome).cast("double")).alias("label"))
    design = assembled(per, columns)
    scores = fit_predict(name, design, design, ["target"], **params)
    return rows.join(scores, "target", "left").select(
        *rows.columns, F.coalesce("score", F.lit(0.0)).alias("propensity")
    )


def shuffled_key(df: DataFrame, keys: Sequence[str], seed: int = 0) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def balanced_rows(train: DataFrame, keys: Sequence[str], method: str, seed: int = 0) -> DataFrame:
    """Resampled training rows."""
    keyed = train.withColumn("_k", shuffled_key(train, keys, seed))
    return resample.resample(keyed, method, "label", "_k").drop("_k")


