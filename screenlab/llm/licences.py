"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs are runs of non-blank lines, and each line is one too.  Those with a
cue word are cut into word n-grams; logistic regression over the n-grams of
licence names and opening sentences tells families and an unknown class apart,
and a prediction counts when a template of its family is found in the paragraph.
All of it is DataFrame operations.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm.common import bound

UNKNOWN = "unknown"
#: Weight of all lines that teach the unknown class together, in numbers of written examples.
BACKGROUND = 4.0
#: Share of a template's word pairs that a paragraph must hold.
CONFIRMED = 0.6

#: Names of public licences by family (fixed values).
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache Software License"),
    "mit": ("MIT License", "MIT-style license", "The MIT License (MIT)"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-style license"),
    "gpl": (
        "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL version 3",
        "GNU General Public License", "GPL-3.0 license", "GPLv3",
    ),
    "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License", "LGPL-2.1 license"),
    "agpl": ("GNU Affero General Public License", "AGPL-3.0 license"),
    "mpl": ("Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0 license"),
    "cc-by-nc": (
        "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License",
        "Creative Commons Attribution-NonCommercial-ShareAlike License",
    ),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"),
    "public-domain": ("CC0 1.0 Universal", "public domain", "The Unlicense", "Public Domain Dedication"),
    "proprietary": ("All rights reserved", "all rights reserved worldwide", "proprietary and confidential license"),
}

#: Opening sentences of licences that do not name themselves (fixed values).
NOTICES: tuple[tuple[str, str], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License "
               "at http://www.apache.org/licenses/LICENSE-2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)

_PHRASES = (
    "{}", "{}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
    "This file is licensed under {}", "Distributed under the terms of the {}", "Copyright 2020 the authors. {}",
    "See the {} for details", "Available under {} terms", "Licensed under {}.",
)

#: Paragraphs with cue words that name no licence (fixed values).
_STRAYS = (
    "the license", "a driving license is required", "licensed under the terms", "copyright law in the digital age",
    "permission to enter was refused", "released under pressure", "this work is the result of years", "version 2.0",
    "version 3", "all rights", "the rights of all", "the general public", "a warranty of one year", "licensed under",
    "this work is licensed", "copyright 2020", "creative people in the commons", "an apache helicopter", "license",
    "no license is granted", "the commons", "released under the", "the terms of the license", "copyright",
)

#: Between two words, also where a line ends and a comment mark starts the next.
_GAP = r"[^\p{L}\p{N}]+"
_CUE = (
    rf"(?i)licen[cs]|copyright|copyleft|warrant|permission|rights{_GAP}reserved|redistribut|public{_GAP}domain"
    rf"|creative{_GAP}commons|\bcc({_GAP})?(by|0)|\ba?l?gplv?|mozilla|unlicense|free{_GAP}software"
)


def _grams(text: Column) -> Column:
    """The distinct runs of one to three words of a text, in lower case."""

    def all_runs(words: Column) -> Column:
        def runs(n: int) -> Column:
            def join(w: Column, i: Column) -> Column:
                return F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)])

            return F.slice(F.transform(words, join), F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(0)))

        return F.array_distinct(F.concat(words, runs(2), runs(3)))

    return bound(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), all_runs)


def _known_grams(text: Column, vocabulary: list[str]) -> Column:
    """`_grams` that are in the vocabulary, in order. It holds all words of its runs, so only these are joined."""

    def all_runs(words: Column) -> Column:
        def runs(n: int) -> Column:
            def join(w: Column, i: Column) -> Column:
                return F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))])

            return F.transform(words, join)

        return F.array_sort(F.array_distinct(F.filter(F.concat(words, runs(2), runs(3)), lambda g: g.isin(vocabulary))))

    single = [g for g in vocabulary if " " not in g]
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return bound(F.transform(words, lambda w: F.when(w.isin(single), w)), all_runs)


def _templates() -> list[tuple[str, str]]:
    return [(f, n) for f, names in NAMES.items() for n in names] + list(NOTICES)


def _examples(spark: SparkSession) -> DataFrame:
    rows = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in _PHRASES]
    rows += [(f, part) for f, n in NOTICES for part in (n, n[: len(n) // 2], n[len(n) // 2 :], n + " and more")]
    rows += [(UNKNOWN, s) for s in _STRAYS for _ in range(3)]
    return spark.createDataFrame(rows, "family string, text string")


def _held(text: Column) -> Column:
    return F.crc32(text.cast("binary")) % 3 == 1


def background(docs: DataFrame, text_col: str, vocabulary: list[str]) -> DataFrame:
    """(grams, held, n): every line of every document without cue words, as examples of the unknown class.

    Lines with the same n-grams of the vocabulary are one row with their number.
    """
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("text"))
    lines = lines.filter(~F.col("text").rlike(_CUE) & (F.col("text") != ""))
    each = lines.select(_known_grams(F.col("text"), vocabulary).alias("grams"), _held(F.col("text")).alias("held"))
    return each.groupBy("grams", "held").agg(F.count(F.lit(1)).alias("n"))


class Scanner:
    """The fitted classifier as expressions: n-gram weights, intercepts, threshold of the unknown class."""

    def __init__(self, vocabulary: list[str], weights: list[list[float]], intercepts: list[float]) -> None:
        self.vocabulary, self.weights, self.intercepts, self.threshold = vocabulary, weights, intercepts, 0.5

    def best(self, grams: Column) -> Column:
        """(family, p): the likeliest family, leaving out the unknown class, and its probability."""
        table = json.dumps(dict(zip(self.vocabulary, self.weights, strict=True)))
        weights = F.from_json(F.lit(table), "map<string,array<double>>")
        known = F.from_json(F.lit(json.dumps(self.vocabulary)), "array<string>")
        start = F.from_json(F.lit(json.dumps(self.intercepts)), "array<double>")

        def add(total: Column, gram: Column) -> Column:
            return F.zip_with(total, F.element_at(weights, gram), lambda x, y: x + y)

        families = F.array(*[F.lit(f) for f in NAMES])

        def likeliest(chances: Column) -> Column:
            named = F.zip_with(
                F.slice(chances, 1, len(NAMES)), families, lambda p, f: F.struct(p.alias("p"), f.alias("family"))
            )
            total = F.aggregate(chances, F.lit(0.0), lambda x, y: x + y)
            return bound(F.array_max(named), lambda t: F.struct(t["family"].alias("family"), (t["p"] / total).alias("p")))

        def relative(logits: Column) -> Column:
            return bound(F.array_max(logits), lambda most: F.transform(logits, lambda x: F.exp(x - most)))

        logits = F.aggregate(F.array_intersect(grams, known), start, add)
        return bound(bound(logits, relative), likeliest)


def fit(docs: DataFrame, text_col: str = "text") -> Scanner:
    """Learn from templates, stray sentences and all lines of the documents that have no cue word.

    The vocabulary is that of the templates, so the model's size doesn't follow
    the corpus. Lines weigh by their number, all together as much as a fixed number of
    written examples, so that these count in any corpus. A third of the examples and lines
    is held out: a family is predicted when it is likelier than any that the held-out
    unknown ones were given.
    """
    spark = docs.sparkSession
    taught = _examples(spark).filter(F.col("family") != UNKNOWN).select(F.explode(_grams(F.col("text"))).alias("g"))
    vocabulary = sorted(r["g"] for r in taught.distinct().collect())
    families = F.array(*[F.lit(f) for f in (*NAMES, UNKNOWN)])
    examples = _examples(spark).select(
        "family", _known_grams(F.col("text"), vocabulary).alias("grams"), _held(F.col("text")).alias("held"), F.lit(1.0).alias("weight")
    )
    # Kept, as the fit reads them again.
    lines = background(docs, text_col, vocabulary).persist()
    total = lines.filter("NOT held").agg(F.sum("n")).first()[0] or 1
    weight = F.col("n") * F.lit(BACKGROUND * examples.count() / total)
    known = examples.unionByName(lines.select(F.lit(UNKNOWN).alias("family"), "grams", "held", weight.alias("weight")))
    known = known.withColumn("label", (F.array_position(families, F.col("family")) - 1).cast("double"))
    vector = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", binary=True)
    learner = LogisticRegression(regParam=1e-4, maxIter=60, standardization=False, family="multinomial", weightCol="weight")
    model = learner.fit(vector.transform(known.filter("NOT held")))
    weights = model.coefficientMatrix.toArray().T.round(6).tolist()
    own = Scanner(vocabulary, weights, model.interceptVector.toArray().round(6).tolist())
    unknown = known.filter(F.col("held") & (F.col("family") == UNKNOWN))
    most = unknown.select(own.best(F.col("grams"))["p"].alias("p")).agg(F.max("p")).first()[0]
    own.threshold = min(0.95, max(0.5, most or 0.0))
    lines.unpersist()
    return own


def _pairs(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def confirmed(family: Column, grams: Column) -> Column:
    """Does the paragraph hold enough of the word pairs of some template of the family?"""
    out = F.lit(False)
    for f, text in _templates():
        pairs = _pairs(text)
        held = F.size(F.array_intersect(grams, F.array(*map(F.lit, pairs))))
        out = out | ((family == f) & (held >= CONFIRMED * len(pairs)))
    return out


def _span(x: Column) -> list[Column]:
    return [x["line"].alias("line"), x["last"].alias("last")]


def candidates(lines: Column) -> Column:
    """(line, last, text) of each line and of each run of more non-blank lines; a blank one has no letter or digit."""

    def blank(i: Column) -> Column:
        return ~F.coalesce(F.get(lines, i), F.lit("")).rlike(r"[\p{L}\p{N}]")

    def edges(step: int) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.filter(at, lambda i: ~blank(i) & blank(i + step))

    def joined(a: Column, b: Column) -> Column:
        return F.struct(a.alias("line"), b.alias("last"), F.array_join(F.slice(lines, a + 1, b - a + 1), "\n").alias("text"))

    each = F.transform(lines, lambda x, i: F.struct(i.alias("line"), i.alias("last"), x.alias("text")))
    runs = F.filter(F.zip_with(edges(-1), edges(1), joined), lambda x: x["last"] > x["line"])
    return F.concat(each, runs)


def stated(found: Column) -> Column:
    """Of confirmed (line, last, family, p): lines, and runs whose family none of their lines states alone.

    Where such a run states another licence, its reservation of rights is part of that notice.
    """

    def inside(x: Column, run: Column) -> Column:
        return (x["last"] == x["line"]) & (x["line"] >= run["line"]) & (x["line"] <= run["last"])

    def own(run: Column) -> Column:
        return (run["last"] > run["line"]) & ~F.exists(found, lambda x: inside(x, run) & (x["family"] == run["family"]))

    def part(x: Column) -> Column:
        reserved = (x["family"] == "proprietary") & (x["last"] == x["line"])
        return reserved & F.exists(found, lambda run: own(run) & inside(x, run))

    return F.array_sort(F.filter(found, lambda x: F.when(x["last"] > x["line"], own(x)).otherwise(~part(x))))


def scan(docs: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """(row, found): each input row as a struct and its licence paragraphs.

    found lists (line, last, family, p) by line number from 0, of lines and runs
    of non-blank lines whose best family is likelier than the threshold and
    confirmed by a template; of a run only what no line of it states alone. Null
    and empty texts have none; those without a cue word are unknown. Repeated rows
    are scanned alike; the row stays in its struct, so no name can clash. It is
    one projection: nothing is shuffled, whatever the share of a source.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    df = df.select("row", F.when(F.col("text").rlike(_CUE), F.split("text", "\n")).alias("split"))
    lines = F.when(F.col("split").isNotNull(), F.filter(candidates(F.col("split")), lambda x: x["text"].rlike(_CUE)))
    none = F.array().cast("array<struct<line:int,last:int,text:string>>")
    df = df.select("row", F.coalesce(lines, none).alias("lines"))
    grams = F.transform("lines", lambda x: F.struct(*_span(x), _grams(x["text"]).alias("grams")))
    df = df.select("row", grams.alias("lines"))

    def judged(x: Column) -> Column:
        def with_best(best: Column) -> Column:
            return F.struct(*_span(x), x["grams"].alias("grams"), best["family"].alias("family"), best["p"].alias("p"))

        return bound(scanner.best(x["grams"]), with_best)

    df = df.select("row", F.transform("lines", judged).alias("lines"))
    good = F.filter("lines", lambda x: (x["p"] >= scanner.threshold) & confirmed(x["family"], x["grams"]))
    out = F.transform(good, lambda x: F.struct(*_span(x), x["family"].alias("family"), x["p"].alias("p")))
    return df.select("row", out.alias("found")).select("row", stated(F.col("found")).alias("found"))
