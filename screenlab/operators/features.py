"""Feature tables in long form: (row keys..., block, feature, value), zeros left out.

Dense vectors are made only at the edge to model fitting (``assemble``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlab.functions import seq as fs
from screenlab.operators import kmers


def block(df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str]) -> DataFrame:
    """Wide columns as a long block."""
    cells = F.array(
        *[F.struct(F.lit(v).alias("feature"), F.col(f"`{v}`").cast("double").alias("value")) for v in values]
    )
    return (
        df.select(*keys, F.explode(F.filter(cells, lambda x: x["value"] != 0)).alias("x"))
        .select(*keys, F.lit(name).alias("block"), "x.feature", "x.value")
    )


def one_hot_block(df: DataFrame, keys: Sequence[str], name: str, value: Column, known: Sequence) -> DataFrame:
    """One indicator per known category; other rows have no entry."""
    text = value.cast("string")
    return df.where(text.isin(*[str(x) for x in known])).select(
        *keys, F.lit(name).alias("block"), F.concat(F.lit(f"{name}_"), text).alias("feature"), F.lit(1.0).alias("value")
    )


def distance_block(df: DataFrame, keys: Sequence[str], distance: str) -> DataFrame:
    """Distance to the neighbour, -1 when unknown."""
    value = F.coalesce(F.col(distance).cast("double"), F.lit(-1.0))
    return df.select(
        *keys, F.lit("distance").alias("block"), F.lit("distance").alias("feature"), value.alias("value")
    )


def kmer_block(
    rows: DataFrame, keys: Sequence[str], on: str, spectra: DataFrame, name: str
) -> DataFrame:
    """Finished spectra (on, kmer, value) attached to every row that uses the sequence."""
    s = spectra.select(on, "kmer", "value")
    return rows.select(*keys, *([on] if on not in keys else [])).join(s, on).select(
        *keys, F.lit(name).alias("block"), F.concat(F.lit(f"{name}_"), "kmer").alias("feature"), "value"
    )


def vector_block(
    rows: DataFrame, keys: Sequence[str], on: str, vectors: DataFrame, name: str, dims: int | None = None
) -> DataFrame:
    """Array columns (on, vec) as features; a row without a vector has an all-zero block."""
    vec = F.slice("vec", 1, dims) if dims else F.col("vec")
    v = vectors.select(on, vec.alias("_v"))
    return (
        rows.select(*keys, *([on] if on not in keys else []))
        .join(v, on)
        .select(*keys, F.posexplode("_v").alias("i", "value"))
        .where(F.col("value") != 0)
        .select(
            *keys,
            F.lit(name).alias("block"),
            F.concat(F.lit(f"{name}_"), F.col("i") + 1).alias("feature"),
            F.col("value").cast("double").alias("value"),
        )
    )


def vector_or_zero(rows: DataFrame, on: str, vectors: DataFrame, dims: int) -> DataFrame:
    """Rows with ``vec``; zeros of the right length where there is none."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    v = vectors.select(on, F.slice("vec", 1, dims).cast("array<double>").alias("_v"))
    return rows.join(v, on, "left").select(*rows.columns, F.coalesce("_v", zeros).alias("vec"))


def union_blocks(*blocks: DataFrame) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def pick_blocks(long: DataFrame, names: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Rows of the named blocks; naming an unknown block is an error."""
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise KeyError(f"unknown blocks {unknown}")
    return long.where(F.col("block").isin(*names))


def pick_features(long: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose feature name starts with one of the prefixes."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("feature").startswith(p)
    return long.where(wanted)


def screen_features(
    records: DataFrame,
    k: int,
    days: Sequence[int],
    cells: Sequence[str],
    bodies: DataFrame | None = None,
    spread: bool = False,
    vocab: DataFrame | None = None,
    body_vectors: DataFrame | None = None,
    guide_vectors: DataFrame | None = None,
) -> DataFrame:
    """Guide-level features: k-mers of the guide and of both body windows, day, cell, distance, embeddings.

    records(record, target, spacer, day, cell, distance), bodies(target, first_seq,
    last_seq), body_vectors(target, vec), guide_vectors(spacer, vec). Spacers and
    bodies are counted once each, however many records share them; a target or
    spacer without a body or vector has zeros there.
    """
    keys = ["record"]
    spacers = records.select("spacer").distinct()
    guide = kmers.kmer_frequencies(
        spacers.select("spacer", F.col("spacer").alias("_s")), ["spacer"], "_s", k, vocab
    )
    blocks = [kmer_block(records, keys, "spacer", guide, "guide")]
    if bodies is not None:
        for side in ("first", "last"):
            body = kmers.kmer_frequencies(bodies, ["target"], f"{side}_seq", k, vocab, spread)
            blocks.append(kmer_block(records, keys, "target", body, f"body_{side}"))
    for on, vectors, name in (("target", body_vectors, "body_emb"), ("spacer", guide_vectors, "guide_emb")):
        if vectors is not None:
            blocks.append(vector_block(records, keys, on, vectors, name))
    blocks += [
        one_hot_block(records, keys, "day", F.col("day"), days),
        one_hot_block(records, keys, "cell", F.col("cell"), cells),
        distance_block(records, keys, "distance"),
    ]
    return union_blocks(*blocks)


def _totals(long: DataFrame, on: str, name: str) -> DataFrame:
    """(on, name: entries, sum, last feature, largest value) of long(on, feature, value)."""
    sums = (F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("feature").alias("last"), F.max("value").alias("top"))
    return long.groupBy(on).agg(*sums).select(on, F.struct("n", "total", "last", "top").alias(name))


def screen_block_totals(
    records: DataFrame, k: int, days: Sequence[int], cells: Sequence[str], bodies: DataFrame, body_vectors: DataFrame
) -> DataFrame:
    """Of every record and block of `screen_features`: entries, sum, last feature and largest value.

    The entries of a block follow from one sequence or vector, so they are summed
    there, and a record meets one row of sums for each of them, not its entries.
    """
    spacers = records.select("spacer").distinct().select("spacer", F.col("spacer").alias("_s"))
    spectra = [(kmers.kmer_frequencies(spacers, ["spacer"], "_s", k), "spacer", "guide")]
    for side in ("first", "last"):
        spectra.append((kmers.kmer_frequencies(bodies, ["target"], f"{side}_seq", k), "target", f"body_{side}"))
    sums = [
        _totals(s.select(on, F.concat(F.lit(f"{name}_"), "kmer").alias("feature"), "value"), on, name)
        for s, on, name in spectra
    ]
    entries = body_vectors.select("target", F.posexplode("vec").alias("i", "value")).where(F.col("value") != 0)
    entries = entries.select("target", F.concat(F.lit("body_emb_"), F.col("i") + 1).alias("feature"), F.col("value").cast("double").alias("value"))
    sums.append(_totals(entries, "target", "body_emb"))
    of_target = sums[1].join(sums[2], "target", "full").join(sums[3], "target", "full")
    met = records.join(of_target, "target", "left").join(sums[0], "spacer", "left")

    def one(feature: Column, value: Column) -> Column:
        return F.struct(F.lit(1).cast("bigint").alias("n"), value.alias("total"), feature.alias("last"), value.alias("top"))

    distance = F.coalesce(F.col("distance").cast("double"), F.lit(-1.0))
    own = {"distance": one(F.lit("distance"), distance)}
    for name, known in (("day", days), ("cell", cells)):
        text = F.col(name).cast("string")
        feature = F.concat(F.lit(f"{name}_"), text)
        own[name] = F.when(text.isin(*[str(x) for x in known]), one(feature, F.lit(1.0)))
    names = ["guide", "body_first", "body_last", "body_emb", *own]
    met = met.select("record", *names[:4], *[x.alias(f"_{n}") for n, x in own.items()])
    # Rows that are the same record count together.
    merged = met.groupBy("record").agg(*[
        F.struct(
            F.lit(n).alias("block"),
            F.sum(x["n"]).alias("n"),
            F.sum(x["total"]).alias("total"),
            F.max(x["last"]).alias("last"),
            F.max(x["top"]).alias("top"),
        ).alias(n)
        for n, x in ((n, F.col(f"_{n}" if n in own else n)) for n in names)
    ])
    return merged.select("record", F.inline(F.array(*names))).where(F.col("n").isNotNull())


def gene_features(
    rows: DataFrame,
    bodies: DataFrame,
    k: int,
    cells: Sequence[str],
    coordinates: DataFrame | None = None,
    dims: int = 2,
    vocab: DataFrame | None = None,
    spread: bool = False,
) -> DataFrame:
    """Gene-level features: body k-mers, cell one-hot, cell coordinates and distance."""
    keys = ["target", "cell"]
    # Counted where they are read: counts are far smaller than texts, and the join leaves the unused ones out.
    body = kmers.kmer_frequencies(bodies, ["target"], "seq", k, vocab, spread)
    blocks = [
        kmer_block(rows, keys, "target", body, "body"),
        one_hot_block(rows, keys, "cell", F.col("cell"), cells),
        distance_block(rows, keys, "distance"),
    ]
    if coordinates is not None:
        blocks.append(vector_block(rows, keys, "cell", coordinates, "coord", dims))
    return union_blocks(*blocks)


def gene_block_sums(
    rows: DataFrame,
    bodies: DataFrame,
    k: int,
    cells: Sequence[str],
    coordinates: DataFrame | None = None,
    dims: int = 2,
    vocab: DataFrame | None = None,
    spread: bool = False,
) -> DataFrame:
    """Of every block and feature of `gene_features`: entries, sum and largest value.

    Rows are counted by target and by cell first; a target's count meets its
    spectrum, a cell's its coordinates, and no row is repeated for its entries.
    """
    body = kmers.kmer_frequencies(bodies, ["target"], "seq", k, vocab, spread)
    uses = rows.groupBy("target").agg(F.count(F.lit(1)).alias("_c"))
    met = kmer_block(uses, ["_c"], "target", body, "body")
    distance = F.coalesce(F.col("distance").cast("double"), F.lit(-1.0))
    of_cell = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(distance).alias("_total"), F.max(distance).alias("_top")
    )
    met = met.unionByName(one_hot_block(of_cell, ["_c"], "cell", F.col("cell"), cells))
    if coordinates is not None:
        met = met.unionByName(vector_block(of_cell, ["_c"], "cell", coordinates, "coord", dims))
    sums = met.groupBy("block", "feature").agg(
        F.sum("_c").alias("n"), F.sum(F.col("value") * F.col("_c")).alias("total"), F.max("value").alias("top")
    )
    far = of_cell.agg(F.sum("_c").alias("n"), F.sum("_total").alias("total"), F.max("_top").alias("top"))
    far = far.where(F.col("n") > 0).select(F.lit("distance").alias("block"), F.lit("distance").alias("feature"), "n", "total", "top")
    return sums.unionByName(far)


def variances(long: DataFrame, rows: Column) -> DataFrame:
    """Population variance per feature over ``rows`` rows, absent entries being zeros."""
    per = long.groupBy("feature").agg(
        F.sum("value").alias("_s"),
        F.avg("value").alias("_m"),
        F.var_pop("value").alias("_v"),
        F.count(F.lit(1)).alias("_k"),
    )
    n = F.col("_n").cast("double")
    share = F.col("_k") / n
    # within the non-zero entries, plus between them and the zeros
    total = F.col("_v") * share + F.col("_m") * F.col("_m") * share * (F.lit(1.0) - share)
    return per.withColumn("_n", rows).select("feature", total.alias("variance"))


def variance_threshold(
    train: DataFrame, rows: Column, every: DataFrame, threshold: float
) -> DataFrame:
    """``every`` cut to the features whose training variance exceeds the threshold."""
    kept = variances(train, rows).where(F.col("variance") > threshold).select("feature")
    return every.join(kept, "feature", "left_semi")


def dimension_stats(vectors: DataFrame, dims: int) -> DataFrame:
    """One row: mean and population sd of every dimension, sd 1 where constant."""
    each = [F.get("vec", F.lit(i)).cast("double") for i in range(dims)]
    sds = [F.stddev_pop(x) for x in each]
    return vectors.agg(
        F.array(*[F.avg(x) for x in each]).alias("mean"),
        F.array(*[F.when(s > 0, s).otherwise(F.lit(1.0)) for s in sds]).alias("sd"),
    )


def standardise(every: DataFrame, train: DataFrame, dims: int) -> DataFrame:
    """``vec`` scaled by the training rows' mean and sd."""
    stats = dimension_stats(train, dims)
    mean, sd = stats.select("mean").scalar(), stats.select("sd").scalar()
    rows = every.select("*", mean.alias("_mean"), sd.alias("_sd"))
    centred = F.zip_with("vec", "_mean", lambda x, m: x.cast("double") - m)
    return rows.select(
        *[c for c in every.columns if c != "vec"],
        F.zip_with(centred, "_sd", lambda x, s: x / s).alias("vec"),
    )


def reduce_pca(every: DataFrame, train: DataFrame, dims: int, components: int) -> DataFrame:
    """First principal components, fitted on the training rows only.

    The fitted projection does not subtract a mean, so rows are standardised by
    the training statistics before.
    """
    components = min(components, dims)
    have = train.limit(components).count()
    if have < components:
        raise ValueError(f"{components} components need as many training rows, got {have}")
    scaled = standardise(every, train, dims).withColumn("_x", array_to_vector("vec"))
    fit_rows = standardise(train, train, dims).withColumn("_x", array_to_vector("vec"))
    model = PCA(k=components, inputCol="_x", outputCol="_y").fit(fit_rows)
    return model.transform(scaled).select(
        *[c for c in every.columns if c != "vec"], vector_to_array("_y").alias("vec")
    )


def mean_vectors(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Average of two embeddings per id."""
    b = second.select(on, F.col("vec").alias("_b"))
    mean = F.zip_with("vec", "_b", lambda x, y: (x.cast("double") + y) / 2.0)
    return first.join(b, on).select(on, mean.alias("vec"))


def windows_to_embed(df: DataFrame, size: int = 1000) -> DataFrame:
    """(target, first_window, last_window): the second falls back to the tail of the first."""
    last = F.coalesce(F.nullif("last_seq", F.lit("")), fs.last_window(F.col("first_seq"), size))
    return df.select(
        "target",
        fs.first_window(F.col("first_seq"), size).alias("first_window"),
        fs.last_window(last, size).alias("last_window"),
    )


def assemble(long: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Dense vectors in the order of ``names``; features not named are dropped.

    A row has at most one entry per named feature, which bounds its group.
    """
    index = {n: i for i, n in enumerate(names)}
    table = F.create_map(*[x for n, i in index.items() for x in (F.lit(n), F.lit(i))])
    at = F.try_element_at(table, F.col("feature"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("_i"), F.col("value"))))
    grouped = (
        long.withColumn("_i", at)
        .where(F.col("_i").isNotNull())
        .groupBy(*keys)
        .agg(entries.alias("_m"))
    )
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)),
    )
    return grouped.select(*keys, array_to_vector(slots).alias("features"))


def require_features(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """``long`` itself, or an error naming features a saved model does not know."""
    extra = long.select("feature").distinct().where(~F.col("feature").isin(*names)).take(3)
    if extra:
        raise ValueError(f"features unknown to the model, e.g. {[r.feature for r in extra]}")
    return long
