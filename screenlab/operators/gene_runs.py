"""From sequences to scores: features fitted on training rows, runs by configuration, saved models.

The vocabulary of a fold is that of its own training targets, so each fold has
its own features; a saved model keeps the vocabulary it was fitted with.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators import kmers, metrics, models, pipeline
from screenlab.operators.boosting import Boosted
from screenlab.session import cut_lineage

KEYS = ["target", "cell"]


def counted_bodies(bodies: DataFrame, k: int) -> DataFrame:
    """bodies(target, seq) as (target, kmers: k-mer and count), a row a target with any.

    Written, as each fold and model takes its features from these counts: texts are
    read and counted once, whatever the number of folds.
    """
    counts = kmers.kmer_counts(bodies, ["target"], "seq", k, spread=True)
    listed = F.map_from_entries(F.collect_list(F.struct("kmer", "n")))  # 4^k entries at most
    return cut_lineage(counts.groupBy("target").agg(listed.alias("kmers")))


def _counted(bodies: DataFrame, k: int) -> DataFrame:
    return bodies if "kmers" in bodies.columns else counted_bodies(bodies, k)


@dataclass(frozen=True)
class GeneFeatures:
    """Body k-mer shares, cell indicators and the distance, in a fixed order of columns.

    ``bodies`` are sequences (target, seq), or `counted_bodies` of the same k.
    """

    k: int
    cells: tuple[str, ...]
    vocabulary: tuple[str, ...]

    @classmethod
    def fit(cls, train: DataFrame, bodies: DataFrame, k: int, cells: Sequence[str]) -> GeneFeatures:
        """The k-mers of the training targets' bodies; there are 4^k at most."""
        used = _counted(bodies, k).join(train.select("target").distinct(), "target", "left_semi")
        found = used.select(F.explode(F.map_keys("kmers")).alias("kmer")).distinct().collect()
        return cls(k, tuple(cells), tuple(sorted(r.kmer for r in found)))

    @property
    def columns(self) -> list[str]:
        return [f"body_{x}" for x in self.vocabulary] + [f"cell_{c}" for c in self.cells] + ["distance"]

    def design(self, rows: DataFrame, bodies: DataFrame) -> DataFrame:
        """rows(target, cell, distance, ...) with ``features``; k-mers outside the vocabulary are left out."""
        known = F.array(*[F.lit(x) for x in self.vocabulary]).cast("array<string>")
        times = F.transform(known, lambda x: F.coalesce(F.try_element_at("kmers", x), F.lit(0)))
        body = _counted(bodies, self.k).select("target", times.alias("_times"))
        total = F.aggregate("_times", F.lit(0).cast("bigint"), lambda a, x: a + x)
        body = body.select("target", "_times", total.alias("_total"))
        shares = F.transform("_times", lambda x: F.coalesce(F.try_divide(x, F.col("_total")), F.lit(0.0)))
        none = F.array_repeat(F.lit(0.0), len(self.vocabulary))
        body = body.select("target", shares.alias("_shares"))
        here = [F.when(F.col("cell") == c, F.lit(1.0)).otherwise(F.lit(0.0)) for c in self.cells]
        distance = F.coalesce(F.col("distance").cast("double"), F.lit(-1.0))
        vector = F.concat(F.coalesce("_shares", none), F.array(*here, distance))
        return rows.join(body, "target", "left").select(*rows.columns, array_to_vector(vector).alias("features"))


@dataclass
class SavedModel:
    """A boosted model with the features it was fitted on."""

    features: GeneFeatures
    model: Boosted

    def save(self, spark: SparkSession, folder: str) -> None:
        told = {"k": self.features.k, "cells": self.features.cells, "vocabulary": self.features.vocabulary}
        text = json.dumps({**told, "model": self.model.text()})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SavedModel:
        """A saved model; one whose width isn't that of its vocabulary is an error."""
        told = json.loads(spark.read.text(folder, wholetext=False).first().value)
        own = GeneFeatures(told["k"], tuple(told["cells"]), tuple(told["vocabulary"]))
        model = Boosted.read(told["model"])
        if len(model.edges) != len(own.columns):
            raise ValueError(f"the model expects {len(model.edges)} columns, its vocabulary makes {len(own.columns)}")
        if any(len(x) != own.k for x in own.vocabulary):
            raise ValueError("the vocabulary has k-mers of another length")
        return cls(own, model)

    def score(self, rows: DataFrame, bodies: DataFrame) -> DataFrame:
        """(target, cell, score) of any rows, one entity or all."""
        unknown = rows.where(~F.col("cell").isin(*self.features.cells)).take(1)
        if unknown:
            raise ValueError(f"a cell unknown to the model: {unknown[0].cell}")
        return models.predicted(self.model, self.features.design(rows, bodies), KEYS)

    def score_one(self, spark: SparkSession, sequence: str, cells: Sequence[str], distance: float | None = None) -> DataFrame:
        """A sequence that no table has, in each of the cells."""
        apart = None if distance is None else float(distance)
        rows = spark.createDataFrame([("query", c, apart) for c in cells], "target string, cell string, distance double")
        return self.score(rows, spark.createDataFrame([("query", sequence.upper())], "target string, seq string"))


def run_from_sequences(
    config: pipeline.Config, train: DataFrame, test: DataFrame, bodies: DataFrame, k: int, cells: Sequence[str]
) -> pipeline.Run:
    """A whole run: folds, features of each fold, search, fit, prediction and scores.

    train/test: target, cell, chrom, label, distance; bodies: target, seq. In each
    fold features and class weights are fitted on, and resampling applied to, its
    training rows only.
    """
    pipeline.validate(config)
    bodies = counted_bodies(bodies, k)

    def prepared(fit_on: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame, GeneFeatures]:
        own = GeneFeatures.fit(fit_on, bodies, k, cells)
        rows = models.weighted(own.design(fit_on, bodies), config.class_weight)
        balanced = models.balanced_rows(rows, KEYS, config.resampling, config.seed)
        return cut_lineage(balanced), cut_lineage(own.design(judged, bodies)), own

    params, cv = dict(config.params), None
    if config.cv != "none":
        design, held = pipeline.with_fold(train, config)
        design = cut_lineage(design)
        parts = {f: prepared(design.where(F.col("fold") != f), design.where(F.col("fold") == f))[:2] for f in held}
        trials = [params]
        if config.tuning == "grid":
            trials = [{**params, **t} for t in models.grid(config.space)]
        elif config.tuning == "random":
            trials = [{**params, **t} for t in models.draws(config.space, config.trials, config.seed)]
        cv = models.search(design, "fold", held, config.model, trials, config.metric, parts=parts.__getitem__)
        params = models.best_params(cv, trials)
    rows, judged, _ = prepared(train, test)
    out = cut_lineage(models.fit_predict(config.model, rows, judged, [*KEYS, "label"], **params))
    scored = metrics.ranking_metrics_by_sets(out, [[], ["cell"]], "score", "label")
    return pipeline.Run(params, cv, out, scored)
