"""Annotation tables as features: fitted categories, lookups over several sources, neighbour blocks.

Features are long rows (key, feature, value), so a column may have any number of
categories; indicators that are 0 have no row.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.functions import maths as fm

#: The name under which missing values are a category of their own.
MISSING = "nan"


def category_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def fit_categories(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, rows): what each column holds in the training rows, missing among them.

    One pass for all columns; a hot category is summed in its tasks first.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), category_of(c).alias("category")) for c in columns])
    return train.select(F.inline(pairs)).groupBy("column", "category").agg(F.count(F.lit(1)).alias("rows"))


def one_hot_rows(df: DataFrame, keys: Sequence[str], fitted: DataFrame) -> DataFrame:
    """(keys, feature, value): 1 for the category of each row and column, if training rows had it.

    Categories never seen in training give no row, as zeros do everywhere else.
    """
    columns = [c for c in df.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), category_of(c).alias("category")) for c in columns])
    rows = df.select(*keys, F.inline(pairs))
    named = F.concat_ws("_", "column", "category").alias("feature")
    return rows.join(fitted.select("column", "category"), ["column", "category"]).select(
        *keys, named, F.lit(1.0).alias("value")
    )


def unseen(df: DataFrame, columns: Sequence[str], fitted: DataFrame) -> DataFrame:
    """(column, category, rows) that training rows never had."""
    return fit_categories(df, columns).join(fitted.select("column", "category"), ["column", "category"], "left_anti")


def number_rows(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """(keys, feature, value) of named expressions, one row each."""
    each = [F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")) for n, v in values.items()]
    return df.select(*keys, F.inline(F.array(*each)))


def static_annotation(
    df: DataFrame,
    keys: Sequence[str],
    numbers: Sequence[str],
    logged: Sequence[str],
    categories: Sequence[str],
    external: Mapping[str, Column],
    fitted: DataFrame,
) -> DataFrame:
    """The annotation block in long form.

    Numbers with -1 for missing; log(1 + x) of the ``logged`` ones, negative and
    missing as 0; indicators of the fitted categories; external values filled with
    0, and whether they were missing.
    """
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in numbers}
    values |= {f"log_{c}": F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in logged}
    for name, x in external.items():
        values[name], values[f"{name}_missing"] = fm.filled(x, name)
    plain = number_rows(df, keys, values)
    return plain.unionByName(one_hot_rows(df.select(*keys, *categories), keys, fitted))


def preferred(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value): of several sources the first that has a value for the keys; one exchange for all."""
    ranked = [s.select(*keys, value, F.lit(k).alias("_rank")) for k, s in enumerate(sources)]
    rows = functools.reduce(DataFrame.unionByName, ranked).where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.min(F.struct("_rank", value)).alias("_x")).select(*keys, F.col(f"_x.{value}"))


def looked_up(rows: DataFrame, on: str, maps: Sequence[DataFrame], values: DataFrame) -> DataFrame:
    """Rows with what their name leads to: name -> id by the first map that knows it, id -> values.

    maps(name, id) in order of preference, each with the ids it prefers first by
    ``rank``; values(id, ...) one row an id. A name without id, or an id without
    values, gives nulls.
    """
    ranked = [
        m.select(F.col("name").alias(on), "id", F.struct(F.lit(k).alias("map"), F.col("rank"), F.col("id").alias("i")).alias("_rank"))
        for k, m in enumerate(maps)
    ]
    known = functools.reduce(DataFrame.unionByName, ranked)
    first = known.groupBy(on).agg(F.min_by("id", "_rank").alias("id"))
    return rows.join(first, on, "left").join(values, "id", "left")


def distance_block(keys: Sequence[str], distance: str, df: DataFrame) -> DataFrame:
    """The distance with -1 for missing, and its log with negative ones as 0."""
    d = F.coalesce(F.col(distance).cast("double"), F.lit(-1.0))
    return number_rows(df, keys, {"distance": d, "log_distance": F.log1p(F.greatest(d, F.lit(0.0)))})


def listed_block(df: DataFrame, keys: Sequence[str], listing: str, names: Sequence[str]) -> DataFrame:
    """1 for every name in a comma-separated cell; a name that isn't known is an error."""
    items = F.explode(F.array_distinct(fm.split_list(F.coalesce(listing, F.lit("")))))
    rows = df.select(*keys, items.alias("_name"))
    bad = F.raise_error(F.concat(F.lit("unknown name "), F.col("_name"))).cast("double")
    value = F.when(F.col("_name").isin(*names), F.lit(1.0)).otherwise(bad)
    return rows.select(*keys, F.concat(F.lit(f"{listing}_"), "_name").alias("feature"), value.alias("value"))


def neighbour_levels(
    rows: DataFrame, maps: Sequence[DataFrame], total: Sequence[DataFrame], mrna: Sequence[DataFrame], samples: Sequence[str]
) -> DataFrame:
    """Five values of a neighbouring gene for every row(..., symbol) and sample.

    The symbol leads to an id by `looked_up`, the id to its levels(gene, sample, value)
    by the first source of each kind that has the gene and sample: log total and
    mRNA level, log mean over the samples, samples of 1 or more, and 1 where the id
    has no total level at all; the other values are 0 then.
    """
    names = F.array(*map(F.lit, samples))

    def wide(sources: Sequence[DataFrame], name: str) -> DataFrame:
        one = preferred(sources, ["gene", "sample"], "value")
        cells = [F.max(F.when(F.col("sample") == s, F.greatest(F.col("value"), F.lit(0.0)))) for s in samples]
        return one.groupBy(F.col("gene").alias("id")).agg(F.array(*cells).alias(name))

    levels = wide(total, "_t").join(wide(mrna, "_m"), "id", "left")
    found = looked_up(rows, "symbol", maps, levels)
    known = F.col("_t").isNotNull()
    level = F.transform(F.coalesce("_t", F.array_repeat(F.lit(0.0), len(samples))), lambda x: F.coalesce(x, F.lit(0.0)))
    spread = found.select(*rows.columns, known.alias("_k"), level.alias("_l"), "_m", F.posexplode(names).alias("_i", "sample"))
    mean = F.aggregate("_l", F.lit(0.0), lambda s, x: s + x) / len(samples)
    return spread.select(
        *rows.columns,
        "sample",
        F.log1p(F.get("_l", F.col("_i"))).alias("log_total"),
        F.when(F.col("_k"), F.log1p(F.coalesce(F.get("_m", F.col("_i")), F.lit(0.0)))).otherwise(F.lit(0.0)).alias("log_mrna"),
        F.log1p(mean).alias("log_mean"),
        F.size(F.filter("_l", lambda x: x >= 1)).cast("double").alias("breadth"),
        (~F.col("_k")).cast("double").alias("missing"),
    )
