"""Guide design: per-guide scalars from built-in expressions, then one aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlab.functions import seq as fs
from screenlab.schema import BASES, GUIDE_LENGTH

METRICS = (
    "gc",
    "entropy",
    "homopolymer",
    "complexity3",
    "self_complementarity",
    "exact_match_count",
    "position",
    "local_gc",
    "local_entropy",
)
OFFSETS = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)


def _sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (target, text, guides) as a row a guide, each searched in its text once."""
    for batch in batches:
        # A few texts at a time, as each may have many guides.
        for at in range(0, batch.num_rows, 256):
            yield from _searched(batch.slice(at, 256))


def _searched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    targets, texts, lists = batch.columns
    texts, of, found = texts.to_pylist(), [], []
    for nth, guides in enumerate(lists):
        text = texts[nth]
        for rc in guides.values.field("_rc").to_pylist():
            of.append(nth)
            start = None if rc is None else text.find(rc)
            if start is None or start < 0:
                found.append((0, start, len(text), "", *[None] * len(OFFSETS)))
                continue
            size = len(rc)
            around = [start + (o if o < 0 else size + o - 1) for o in OFFSETS]
            flanks = [text[i] if 0 <= i < len(text) else None for i in around]
            context = text[max(start - 50, 0) : start + size + 50]
            found.append((text.count(rc, start) if rc else 0, start, len(text), context, *flanks))
    if not found:
        return
    guides = lists.flatten()
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * (1 + len(OFFSETS))]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
    names = ["exact_match_count", "at", "transcript_length", "context", *[f"flank_{o:+d}" for o in OFFSETS]]
    own = [guides.field("guide_id"), targets.take(pa.array(of)), guides.field("spacer")]
    yield pa.record_batch([*own, *columns], ["guide_id", "target", "spacer", *names])


def guide_sites(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """guides(guide_id, target, spacer) with match count, first site and site context.

    A transcript meets the list of its guides once; only the context around a site
    travels further.
    """
    rc = F.reverse(F.translate("spacer", "ACGT", "TGCA"))
    listed = guides.groupBy("target").agg(F.collect_list(F.struct("guide_id", "spacer", rc.alias("_rc"))).alias("_g"))
    joined = listed.join(transcripts.select("target", "seq"), "target", "left").select(
        "target", F.coalesce("seq", F.lit("")).alias("_t"), "_g"
    )
    kinds = dict(guides.dtypes)
    flanks = ", ".join(f"`flank_{o:+d}` string" for o in OFFSETS)
    return joined.mapInArrow(
        _sites,
        f"guide_id {kinds['guide_id']}, target {kinds['target']}, spacer string, exact_match_count long,"
        f" at int, transcript_length int, context string, {flanks}",
    )


def guide_metrics(sites: DataFrame) -> DataFrame:
    """The nine per-guide design values."""
    s = F.col("spacer")
    c = F.col("context")
    return sites.select(
        "*",
        fs.gc_fraction(s).alias("gc"),
        fs.base_entropy(s).alias("entropy"),
        fs.longest_homopolymer(s).alias("homopolymer"),
        fs.complexity3(s).alias("complexity3"),
        fs.self_complement_run(s).alias("self_complementarity"),
        fs.relative_position(F.col("at"), F.col("transcript_length"), F.length(s)).alias(
            "position"
        ),
        fs.gc_fraction(c).alias("local_gc"),
        fs.base_entropy(c).alias("local_entropy"),
    )


def guide_design(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Guide count, nine metrics x mean/std/min/max, match shares and site spread per target."""
    m = guide_metrics(guide_sites(guides, transcripts))
    n = F.count(F.lit(1))
    found = F.col("at") >= 0
    unique = F.col("exact_match_count") == 1
    good = (
        F.col("gc").between(0.35, 0.65)
        & (F.col("homopolymer") < 4)
        & (F.col("self_complementarity") < 7)
        & unique
    )
    aggs = [n.alias("guide_count")]
    for name in METRICS:
        x = F.col(name).cast("double")
        aggs += [
            F.avg(x).alias(f"guide_{name}_mean"),
            F.stddev_pop(x).alias(f"guide_{name}_std"),
            F.min(x).alias(f"guide_{name}_min"),
            F.max(x).alias(f"guide_{name}_max"),
        ]
    placed = F.when(found, F.col("position"))
    aggs += [
        (F.count_if(F.col("exact_match_count") > 0) / n).alias("guide_exact_match_fraction"),
        (F.count_if(unique) / n).alias("guide_unique_match_fraction"),
        (F.count_if(good) / n).alias("guide_high_quality_fraction"),
        F.coalesce(F.max(placed) - F.min(placed), F.lit(0.0)).alias("guide_position_range"),
        (F.count_distinct(placed) / n).alias("guide_position_unique_fraction"),
    ]
    return m.groupBy("target").agg(*aggs)


def positional_bases(guides: DataFrame) -> DataFrame:
    """Share of each base at each of the 23 guide positions, long."""
    letters = F.posexplode(F.split(F.substring("spacer", 1, GUIDE_LENGTH), ""))
    each = guides.select("target", letters.alias("pos", "base")).where(F.col("base").isin(*BASES))
    counts = each.groupBy("target", "pos", "base").agg(F.count(F.lit(1)).alias("_n"))
    totals = guides.groupBy("target").agg(F.count(F.lit(1)).alias("_guides"))
    return counts.join(totals, "target").select(
        "target", "pos", "base", (F.col("_n") / F.col("_guides")).alias("share")
    )


def dinucleotides_pooled(guides: DataFrame) -> DataFrame:
    """Shares among all valid dinucleotides of a target's guides, long."""
    pairs = guides.select("target", F.explode(fs.kmers(F.col("spacer"), 2)).alias("pair"))
    counts = pairs.groupBy("target", "pair").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("target").agg(F.sum("_n").alias("_all"))
    return counts.join(totals, "target").select(
        "target", "pair", (F.col("_n") / F.col("_all")).alias("share")
    )


def dinucleotides_per_guide(guides: DataFrame) -> DataFrame:
    """Each guide's own dinucleotide shares, averaged over the target's guides, long."""
    own = fs.kmers(F.col("spacer"), 2)
    each = guides.select(
        "target", "guide_id", F.size(own).alias("_all"), F.explode(own).alias("pair")
    )
    summed = each.groupBy("target", "pair").agg(F.sum(F.lit(1.0) / F.col("_all")).alias("_s"))
    totals = guides.groupBy("target").agg(F.count(F.lit(1)).alias("_guides"))
    return summed.join(totals, "target").select(
        "target", "pair", (F.col("_s") / F.col("_guides")).alias("share")
    )


def flank_bases(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Share of each base at -5..-1 and +1..+5 around the site, long."""
    sites = guide_sites(guides, transcripts)
    totals = sites.groupBy("target").agg(F.count(F.lit(1)).alias("_guides"))
    each = F.array(
        *[F.struct(F.lit(o).alias("offset"), F.col(f"flank_{o:+d}").alias("base")) for o in OFFSETS]
    )
    counts = (
        sites.select("target", F.explode(each).alias("f"))
        .select("target", "f.offset", "f.base")
        .where(F.col("base").isin(*BASES))
        .groupBy("target", "offset", "base")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counts.join(totals, "target").select(
        "target", "offset", "base", (F.col("_n") / F.col("_guides")).alias("share")
    )


def guide_summary(guides: DataFrame) -> DataFrame:
    """The nine-column summary over guides made of A, C, G, T only."""
    s = F.col("spacer")
    clean = guides.where(s.rlike("^[ACGT]+$")).select(
        "target",
        fs.gc_of_length(s).alias("gc"),
        fs.longest_homopolymer(s).alias("homo"),
        fs.complexity3(s).alias("cplx"),
        fs.self_complement_share(s).alias("selfc"),
    )
    return clean.groupBy("target").agg(
        F.count(F.lit(1)).alias("guide_count"),
        F.avg("gc").alias("guide_gc_mean"),
        F.stddev_pop("gc").alias("guide_gc_std"),
        F.min("gc").alias("guide_gc_min"),
        F.max("gc").alias("guide_gc_max"),
        F.avg("homo").alias("guide_homopolymer_mean"),
        F.max("homo").alias("guide_homopolymer_max"),
        F.avg("cplx").alias("guide_complexity_mean"),
        F.avg("selfc").alias("guide_selfcomp_mean"),
    )


def guide_positions(guides: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Where a target's clean guides sit: share located, mean/std/min/max/range, -1 if none."""
    clean = guides.where(F.col("spacer").rlike("^[ACGT]+$"))
    sites = guide_sites(clean, transcripts)
    span = F.col("transcript_length") - GUIDE_LENGTH
    rel = F.when((F.col("at") >= 0) & (span > 0), F.col("at") / F.nullif(span, F.lit(0)))
    none = F.lit(-1.0)
    return sites.select("target", rel.alias("rel")).groupBy("target").agg(
        (F.count("rel") / F.count(F.lit(1))).alias("located"),
        F.coalesce(F.avg("rel"), none).alias("pos_mean"),
        F.coalesce(F.stddev_pop("rel"), none).alias("pos_std"),
        F.coalesce(F.min("rel"), none).alias("pos_min"),
        F.coalesce(F.max("rel"), none).alias("pos_max"),
        F.coalesce(F.max("rel") - F.min("rel"), none).alias("pos_range"),
    )
