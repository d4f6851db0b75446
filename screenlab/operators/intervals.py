"""Interval merge, overlap join, sequence extraction and transcript architecture.

Intervals are half-open [s, e) unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlab.functions import seq as fs
from screenlab.operators.ordered import first_by
from screenlab.session import cut_lineage

CHUNK = 8192


def to_half_open(start: Column, end: Column) -> tuple[Column, Column]:
    """1-based closed [start, end] as 0-based half-open."""
    return start - 1, end


def to_closed(start: Column, end: Column) -> tuple[Column, Column]:
    return start + 1, end


def merge(df: DataFrame, by: Sequence[str], gap: int = 0) -> DataFrame:
    """Union of the intervals of each group.

    Intervals join when ``next.s <= last.e + gap``: 0 merges half-open intervals
    that touch, 1 merges closed integer intervals that are adjacent.

    A group's intervals are first reduced to one per start (the longest), which
    bounds a group by the number of distinct starts rather than of rows.
    """
    reduced = df.groupBy(*by, "s").agg(F.max("e").alias("e"))
    ordered = Window.partitionBy(*by).orderBy("s")
    so_far = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    flagged = reduced.select(
        *by,
        "s",
        "e",
        F.when(F.col("s") <= so_far + gap, 0).otherwise(1).alias("_new"),
    )
    island = F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return (
        flagged.select(*by, "s", "e", island.alias("_island"))
        .groupBy(*by, "_island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("_island")
    )


#: Blocks of tiles whose summaries are scanned in one array a group.
BLOCKS = 1024


def before_tile(tiles: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, tile, before): the largest value of all earlier tiles of the group, one row a tile.

    Tiles are put into at most BLOCKS blocks by their number. Inside a block they
    are scanned in order; the blocks' largest values are one short array a group.
    """
    ends = tiles.agg(F.min("tile").alias("a"), F.max("tile").alias("b"))
    low, high = ends.select("a").scalar(), ends.select("b").scalar()
    block = F.floor((F.col("tile") - low) / F.ceil((high - low + 1) / BLOCKS))
    blocked = tiles.select(*by, "tile", value, block.alias("_block"))
    each = blocked.groupBy(*by, "_block").agg(F.max(value).alias("_m"))
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", "_m"))).alias("_l"))
    kind = dict(tiles.dtypes)[value]
    none = F.lit(None).cast(kind)
    start = F.struct(F.array().cast(f"array<struct<_block:bigint,_e:{kind}>>").alias("out"), none.alias("m"))

    def add(a: Column, x: Column) -> Column:
        here = F.struct(x["_block"].alias("_block"), a["m"].alias("_e"))
        return F.struct(F.concat(a["out"], F.array(here)).alias("out"), F.greatest(a["m"], x["_m"]).alias("m"))

    earlier = listed.select(*by, F.inline(F.aggregate("_l", start, add, lambda a: a["out"])))
    inside = Window.partitionBy(*by, "_block").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocked.withColumn("_i", F.max(value).over(inside))
    return scanned.join(earlier, [*by, "_block"]).select(*by, "tile", F.greatest("_i", "_e").alias("before"))


def merge_wide(df: DataFrame, by: Sequence[str], width: int, gap: int = 0) -> DataFrame:
    """``merge`` for groups too large for one task (a chromosome).

    Intervals are merged inside tiles of ``width`` first. An island of a tile
    begins a new one if no interval of an earlier tile reaches it; all others of
    its tile come before those, and belong to the last that began in an earlier
    tile. Both are prefix maxima over the tiles' summaries.
    """
    tile = F.floor(F.col("s") / width)
    # Islands and their marks are read several times, so they are written.
    inside = cut_lineage(merge(df.select(*by, tile.alias("tile"), "s", "e"), [*by, "tile"], gap))
    reach = inside.groupBy(*by, "tile").agg(F.max("e").alias("e"))
    marked = inside.join(before_tile(reach, by, "e"), [*by, "tile"])
    fresh = F.col("before").isNull() | (F.col("s") > F.col("before") + gap)
    marked = cut_lineage(marked.select(*by, "tile", "s", "e", fresh.alias("_fresh")))
    begun = marked.groupBy(*by, "tile").agg(F.max(F.when(F.col("_fresh"), F.col("s"))).alias("begun"))
    owned = marked.join(before_tile(begun, by, "begun"), [*by, "tile"])
    first = F.when(F.col("_fresh"), F.col("s")).otherwise(F.col("before"))
    return owned.select(*by, first.alias("_first"), "e").groupBy(*by, "_first").agg(F.max("e").alias("e")).select(
        *by, F.col("_first").alias("s"), "e"
    )


def with_bins(df: DataFrame, width: int) -> DataFrame:
    """One row per bin of ``width`` that the interval touches."""
    first, last = F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)
    return df.select("*", F.explode(F.sequence(first, last)).alias("_bin"))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """Pairs of overlapping intervals with their overlap length.

    Both sides are spread over bins and equi-joined on (on, bin); a pair that
    shares several bins is kept only in the first of them.  Right columns other
    than ``on`` get the prefix ``r_``.
    """
    a = with_bins(left.where(F.col("e") > F.col("s")), width)
    b = with_bins(right.where(F.col("e") > F.col("s")), width)
    b = b.select(*on, "_bin", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    first = F.greatest(F.floor(F.col("s") / width), F.floor(F.col("r_s") / width))
    overlap = F.least("e", "r_e") - F.greatest("s", "r_s")
    return (
        a.join(b, [*on, "_bin"])
        .where((F.col("_bin") == first) & (overlap > 0))
        .select(
            *left.columns,
            *[f"r_{c}" for c in right.columns if c not in on],
            overlap.alias("overlap"),
        )
    )


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """Left rows that overlap anything on the right, once each, as a semi-join.

    The right side is merged first, so a place covered many times counts once.
    """
    merged = merge_wide(right.select(*on, "s", "e"), on, width)
    pairs = overlap_join(left.select(*left.columns), merged, on, width)
    return pairs.select(*left.columns).distinct()


def conservation(exons: DataFrame, elements: DataFrame, width: int) -> DataFrame:
    """Per gene: covered share of exonic bases, elements hit, top score, weighted mean, top lod.

    exons(gene, chrom, s, e), elements(element, chrom, s, e, score, lod).
    """
    merged = merge(exons.select("gene", "chrom", "s", "e"), ["gene", "chrom"])
    exonic = merged.groupBy("gene").agg(F.sum(F.col("e") - F.col("s")).alias("_exonic"))
    hits = (
        overlap_join(merged, elements, ["chrom"], width)
        .groupBy("gene", "r_element")
        .agg(
            F.sum("overlap").alias("_ov"),
            F.max("r_score").alias("_score"),
            F.max("r_lod").alias("_lod"),
        )
        .groupBy("gene")
        .agg(
            F.sum("_ov").alias("_covered"),
            F.count(F.lit(1)).alias("cons_n"),
            F.max("_score").alias("cons_max"),
            F.sum(F.col("_score") * F.col("_ov")).alias("_weighted"),
            F.max("_lod").alias("cons_maxlod"),
        )
    )
    zero = F.lit(0.0)
    return exonic.join(hits, "gene", "left").select(
        "gene",
        F.coalesce(F.try_divide(F.col("_covered"), F.col("_exonic")), zero).alias("cons_frac"),
        F.coalesce("cons_n", F.lit(0)).alias("cons_n"),
        F.coalesce("cons_max", zero).alias("cons_max"),
        F.coalesce(F.try_divide(F.col("_weighted"), F.col("_covered")), zero).alias("cons_mean"),
        F.coalesce("cons_maxlod", zero).alias("cons_maxlod"),
    )


def architecture(exons: DataFrame) -> DataFrame:
    """Twelve transcript statistics per gene from closed exons(gene, tx, s, e)."""
    bases = F.col("e") - F.col("s") + 1
    per_tx = exons.groupBy("gene", "tx").agg(
        F.sum(bases).cast("double").alias("_len"), F.count(F.lit(1)).alias("_exons")
    )
    stats = per_tx.groupBy("gene").agg(
        F.count(F.lit(1)).alias("_tx"),
        F.max("_len").alias("_longest"),
        F.avg("_len").alias("_mean"),
        F.min("_len").alias("_shortest"),
        F.stddev_pop("_len").alias("_sd"),
        F.avg("_exons").alias("_mean_exons"),
        F.max("_exons").cast("double").alias("_max_exons"),
        F.stddev_pop("_exons").alias("_sd_exons"),
    )
    union = merge(exons.select("gene", "s", "e"), ["gene"], gap=1).groupBy("gene").agg(
        F.sum(bases).alias("_union"), (F.max("e") - F.min("s") + 1).alias("_span")
    )
    floor = F.lit(1e-6)
    c = F.col
    return stats.join(union, "gene").select(
        "gene",
        F.log1p(c("_tx")).alias("log_transcript_count"),
        F.log1p(c("_longest")).alias("log_longest_exonic_length"),
        F.log1p(c("_mean")).alias("log_mean_exonic_length"),
        F.log1p(c("_shortest")).alias("log_shortest_exonic_length"),
        (c("_sd") / F.greatest(c("_mean"), floor)).alias("transcript_length_cv"),
        (c("_longest") / F.greatest(c("_mean"), floor)).alias("longest_to_mean_length"),
        c("_mean_exons").alias("mean_exon_count"),
        c("_max_exons").alias("max_exon_count"),
        (c("_sd_exons") / F.greatest(c("_mean_exons"), floor)).alias("exon_count_cv"),
        F.log1p(c("_union")).alias("log_union_exonic_bp"),
        F.log1p(c("_span")).alias("log_genomic_span"),
        (c("_union") / F.greatest(c("_longest"), floor)).alias("union_to_longest_ratio"),
    )


def gene_bounds(exons: DataFrame) -> DataFrame:
    return exons.groupBy("gene").agg(
        F.min("chrom").alias("chrom"),
        F.min("s").alias("s"),
        F.max("e").alias("e"),
        F.min("strand").alias("strand"),
    )


def chunks_of(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """contigs(chrom, seq) cut into pieces of ``size`` letters: (chrom, chunk, piece).

    Bytes are cut, as a cut in a text walks to its place from the start.
    """
    lines = contigs.select("chrom", F.lit(0).cast("bigint").alias("at"), F.col("seq").cast("binary").alias("letters"))
    return _cut(lines, size).select("chrom", "chunk", F.col("piece").cast("string").alias("piece"))


def _cut(lines: DataFrame, size: int) -> DataFrame:
    """(chrom, chunk, start, piece): lines(chrom, at, letters) cut where chunks meet."""
    numbers = F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + length(letters) - 1) div {size}"))
    cut = lines.where(F.length("letters") > 0).select("chrom", "at", "letters", F.explode(numbers).alias("chunk"))
    start = F.greatest(F.col("at"), F.col("chunk") * size)
    end = F.least(F.col("at") + F.length("letters"), (F.col("chunk") + 1) * size)
    piece = F.substring("letters", (start - F.col("at") + 1).cast("int"), (end - start).cast("int"))
    return cut.select("chrom", "chunk", start.alias("start"), piece.alias("piece"))


def chunks_of_lines(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """Placed lines (chrom, at, letters) as pieces of ``size`` letters: (chrom, chunk, piece).

    No row holds more of a contig than a line or a piece.
    """
    parts = _cut(lines, size).select("chrom", "chunk", "start", F.col("piece").cast("string").alias("part"))
    return parts.groupBy("chrom", "chunk").agg(_joined(["start"]).alias("piece"))


def _parts(
    intervals: DataFrame, chunks: DataFrame, carry: Sequence[str], size: int
) -> DataFrame:
    """(carry..., chunk, part): the letters of each half-open interval, chunk by chunk.

    An interval meets only the chunks it touches.
    """
    touched = F.sequence(
        F.floor(F.greatest(F.col("s"), F.lit(0)) / size), F.floor((F.col("e") - 1) / size)
    )
    spans = intervals.where((F.col("e") > F.col("s")) & (F.col("e") > 0)).select(
        *carry, "chrom", F.greatest("s", F.lit(0)).alias("s"), "e", F.explode(touched).alias("chunk")
    )
    start = F.greatest(F.col("s") - F.col("chunk") * size, F.lit(0))
    stop = F.least(F.col("e") - F.col("chunk") * size, F.lit(size))
    part = F.substring(F.col("piece"), (start + 1).cast("int"), (stop - start).cast("int"))
    return spans.join(chunks, ["chrom", "chunk"]).select(*carry, "chunk", part.alias("part"))


def _joined(order: Sequence[str], when: Column | None = None) -> Column:
    """Aggregate: the parts in order, as one text.  A result is one value, so its
    parts fit one task."""
    packed = F.struct(*order, "part")
    kept = F.collect_list(packed if when is None else F.when(when, packed))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["part"]), "")


def _sense(seq: Column) -> Column:
    return F.when(F.col("strand") == "-", fs.reverse_complement(seq)).otherwise(seq)


def extract(intervals: DataFrame, chunks: DataFrame, key: str, size: int = CHUNK) -> DataFrame:
    """Letters of each half-open interval(key, chrom, s, e), clipped to the contig.

    An interval that meets no contig has no row.
    """
    parts = _parts(intervals, chunks, [key], size)
    return parts.groupBy(key).agg(_joined(["chunk"]).alias("seq"))


def span_sequences(bounds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sense-strand sequence of whole genes from closed bounds."""
    s, e = to_half_open(F.col("s"), F.col("e"))
    spans = bounds.select("gene", "strand", "chrom", s.alias("s"), e.alias("e"))
    parts = _parts(spans, chunks, ["gene", "strand"], CHUNK)
    whole = parts.groupBy("gene", "strand").agg(_joined(["chunk"]).alias("seq"))
    return whole.select("gene", _sense(F.col("seq")).alias("seq"))


def end_windows(bounds: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """First and last ``size`` sense-strand letters of each gene."""
    start, end = F.col("s") - 1, F.col("e")
    left = F.struct(start.alias("s"), F.least(end, start + size).alias("e"))
    right = F.struct(F.greatest(start, end - size).alias("s"), end.alias("e"))
    forward = F.col("strand") != "-"
    sides = F.array(
        F.struct(F.lit("first").alias("side"), F.when(forward, left).otherwise(right).alias("w")),
        F.struct(F.lit("last").alias("side"), F.when(forward, right).otherwise(left).alias("w")),
    )
    ends = bounds.select("gene", "chrom", "strand", F.explode(sides).alias("x")).select(
        "gene", "chrom", "strand", "x.side", "x.w.s", "x.w.e"
    )
    parts = _parts(ends, chunks, ["gene", "strand", "side"], CHUNK)
    both = parts.groupBy("gene", "strand").agg(
        *[_joined(["chunk"], F.col("side") == s).alias(s) for s in ("first", "last")]
    )
    return both.select(
        "gene",
        _sense(F.col("first")).alias("first_window"),
        _sense(F.col("last")).alias("last_window"),
    )


def longest_transcript(exons: DataFrame) -> DataFrame:
    """The transcript with most exonic bases per gene; the first on a tie."""
    lengths = exons.groupBy("gene", "tx").agg(
        F.sum(F.col("e") - F.col("s") + 1).alias("bases")
    )
    return first_by(lengths, ["gene"], [-F.col("bases"), F.col("tx")], ["tx", "bases"])


def spliced_sequences(exons: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exons of the longest transcript joined in order and turned to the sense strand."""
    chosen = exons.join(longest_transcript(exons).select("gene", "tx"), ["gene", "tx"])
    s, e = to_half_open(F.col("s"), F.col("e"))
    spans = chosen.select(
        "gene", "strand", "chrom", F.col("s").alias("start"), s.alias("s"), e.alias("e")
    )
    parts = _parts(spans, chunks, ["gene", "strand", "start"], CHUNK)
    whole = parts.groupBy("gene", "strand").agg(_joined(["start", "chunk"]).alias("seq"))
    return whole.select("gene", _sense(F.col("seq")).alias("seq"))


def resolve_names(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Contig name as given, or with/without the "chr" prefix; NULL when neither exists."""
    other = F.when(F.col("chrom").startswith("chr"), F.expr("substring(chrom, 4)")).otherwise(
        F.concat(F.lit("chr"), F.col("chrom"))
    )
    names = have.select(F.col("chrom").alias("_name"))
    return (
        wanted.select("*", other.alias("_other"))
        .join(names, F.col("chrom") == F.col("_name"), "left")
        .withColumnRenamed("_name", "_as_is")
        .join(names, F.col("_other") == F.col("_name"), "left")
        .select(*wanted.columns, F.coalesce("_as_is", "_name").alias("contig"))
    )
