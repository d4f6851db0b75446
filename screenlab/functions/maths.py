"""Numeric expressions shared by the feature builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenlab.schema import P_FLOOR, STRENGTH_CAP


def number(x: Column) -> Column:
    """NULL and NaN as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def safe_log1p(x: Column) -> Column:
    """log(1 + x) with missing and negative values as 0."""
    return F.log1p(F.greatest(number(x), F.lit(0.0)))


def strength(p: Column) -> Column:
    """-log10 p, floored and capped."""
    return F.least(-F.log10(F.greatest(p, F.lit(P_FLOOR))), F.lit(STRENGTH_CAP))


def signed_log_p(p: Column, fc: Column) -> Column:
    """-log10 p, positive for depletion and negative otherwise."""
    size = -F.log10(F.greatest(p, F.lit(P_FLOOR)))
    return F.when(fc < 0, size).otherwise(-size)


def effect(fc: Column) -> Column:
    return F.greatest(-fc, F.lit(0.0))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def safe_ratio(a: Column, b: Column) -> Column:
    """a over b, with b no smaller than 1e-6."""
    return a / F.greatest(b, F.lit(1e-6))


def clip(y: Column, limit: Column) -> Column:
    return F.greatest(F.least(y, limit), -limit)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x
    )


def two_set_probability(logits: Column, yes: Sequence[int], no: Sequence[int]) -> Column:
    """Softmax mass on the positions ``yes`` against ``no``; NULL without mass.

    Logits are shifted by the largest of the chosen ones before ``exp``.
    """
    chosen = F.array(*[F.get(logits, F.lit(i)).cast("double") for i in [*yes, *no]])
    top = F.array_max(F.filter(chosen, lambda x: x.isNotNull()))

    def mass(ids: Sequence[int]) -> Column:
        picked = F.array(*[F.get(logits, F.lit(i)).cast("double") for i in ids])
        known = F.filter(picked, lambda x: x.isNotNull())
        return F.aggregate(known, F.lit(0.0), lambda s, x: s + F.exp(x - top))

    return F.try_divide(mass(yes), mass(yes) + mass(no))


def one_hot(value: Column, categories: Sequence[str], prefix: str) -> list[Column]:
    """An indicator per category; an unknown or missing value gives zeros."""
    return [
        F.coalesce((value == F.lit(c)).cast("double"), F.lit(0.0)).alias(f"{prefix}{c}")
        for c in categories
    ]


def multi_hot(listing: Column, categories: Sequence[str], prefix: str) -> list[Column]:
    """Indicators from a comma-separated cell."""
    items = split_list(listing)
    return [
        F.coalesce(F.array_contains(items, c).cast("double"), F.lit(0.0)).alias(f"{prefix}{c}")
        for c in categories
    ]


def split_list(listing: Column) -> Column:
    parts = F.transform(F.split(listing, ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def unknown_items(listing: Column, categories: Sequence[str]) -> Column:
    """Items of a comma-separated cell that are not among the categories."""
    known = F.array(*[F.lit(c) for c in categories])
    return F.array_except(split_list(F.coalesce(listing, F.lit(""))), known)


def filled(x: Column, name: str, value: float = 0.0) -> list[Column]:
    """The value with missing as ``value``, and the missing indicator."""
    return [
        F.coalesce(x.cast("double"), F.lit(value)).alias(name),
        x.isNull().cast("double").alias(f"{name}_missing"),
    ]


def stage_rank(stage: Column, postnatal: Sequence[str]) -> Column:
    """"<n>wpc" as n; postnatal stages follow from 100 in the given order."""
    lower = F.lower(stage)
    weeks = F.regexp_extract(lower, r"^(\d+)wpc$", 1)
    order = F.array_position(F.array(*[F.lit(s) for s in postnatal]), lower)
    return (
        F.when(lower.endswith("wpc"), weeks.try_cast("double"))
        .when(order > 0, (order + 99).cast("double"))
    )


# Fixed value: a number in free text.
NUMBER = r"(?<![A-Za-z\d])[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?"


def first_number(text: Column) -> Column:
    """First number in free text, NULL when there is none."""
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")
