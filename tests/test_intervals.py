"""Interval operators against brute force."""

import random

import pytest

from screenlab.operators import intervals


def union(rows, gap=0):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("gap", [0, 1])
def test_merge(spark, gap):
    rng = random.Random(3)
    rows = [("c", s, s + rng.randint(1, 9)) for s in (rng.randrange(2000) for _ in range(300))]
    df = spark.createDataFrame(rows, "chrom string, s long, e long")
    want = union([(s, e) for _, s, e in rows], gap)
    for got in (intervals.merge(df, ["chrom"], gap), intervals.merge_wide(df, ["chrom"], 64, gap)):
        assert sorted((r.s, r.e) for r in got.collect()) == want


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlap_join(spark, width):
    rng = random.Random(4)

    def some(n):
        return [(i, rng.choice("xy"), s, s + rng.randint(0, 60)) for i, s in enumerate(rng.randrange(500) for _ in range(n))]

    a, b = some(80), some(90)
    left = spark.createDataFrame(a, "id long, chrom string, s long, e long")
    right = spark.createDataFrame(b, "id long, chrom string, s long, e long")
    got = sorted((r.id, r.r_id, r.overlap) for r in intervals.overlap_join(left, right, ["chrom"], width).collect())
    want = sorted(
        (i, j, min(e, f) - max(s, t))
        for i, c, s, e in a
        for j, d, t, f in b
        if c == d and min(e, f) > max(s, t)
    )
    assert got == want
    semi = {r.id for r in intervals.overlapping(left, right, ["chrom"], width).collect()}
    assert semi == {i for i, _, _ in want}


def test_extract_across_chunks(spark):
    text = "".join(random.Random(5).choice("ACGTN") for _ in range(100))
    contigs = spark.createDataFrame([("c", text)], "chrom string, seq string")
    spans = [(1, "c", 0, 100), (2, "c", 9, 31), (3, "c", 95, 200), (4, "c", -5, 3), (5, "z", 0, 5)]
    df = spark.createDataFrame(spans, "id long, chrom string, s long, e long")
    got = {r.id: r.seq for r in intervals.extract(df, intervals.chunks_of(contigs, 10), "id", 10).collect()}
    assert got == {1: text, 2: text[9:31], 3: text[95:], 4: text[:3]}


def test_spliced_minus_strand(spark):
    contigs = spark.createDataFrame([("c", "AACCCGGGGTTTTT")], "chrom string, seq string")
    rows = [("g", "t", "c", 1, 2, "-"), ("g", "t", "c", 6, 9, "-"), ("g", "u", "c", 3, 3, "-")]
    exons = spark.createDataFrame(rows, "gene string, tx string, chrom string, s long, e long, strand string")
    got = intervals.spliced_sequences(exons, intervals.chunks_of(contigs)).first()
    assert got.seq == "CCCCTT"  # AA + GGGG turned round
    ends = intervals.end_windows(intervals.gene_bounds(exons), intervals.chunks_of(contigs), 3).first()
    assert (ends.first_window, ends.last_window) == ("CCC", "GTT")


def test_longest_transcript_tie_goes_to_the_first(spark):
    rows = [("g", "b", 1, 5), ("g", "a", 11, 15), ("g", "c", 1, 2)]
    df = spark.createDataFrame(rows, "gene string, tx string, s long, e long")
    assert intervals.longest_transcript(df).first().tx == "a"


def test_conservation_counts_an_element_once(spark):
    exons = spark.createDataFrame([("g", "c", 0, 10), ("g", "c", 20, 30), ("h", "d", 0, 5)], "gene string, chrom string, s long, e long")
    elements = spark.createDataFrame([(1, "c", 5, 25, 2.0, 7.0)], "element long, chrom string, s long, e long, score double, lod double")
    got = {r.gene: r for r in intervals.conservation(exons, elements, 8).collect()}
    assert (got["g"].cons_frac, got["g"].cons_n, got["g"].cons_mean, got["g"].cons_maxlod) == (0.5, 1, 2.0, 7.0)
    assert (got["h"].cons_frac, got["h"].cons_n) == (0.0, 0)


def test_contig_names(spark):
    wanted = spark.createDataFrame([("1",), ("chr2",), ("3",), ("chrX",)], "chrom string")
    have = spark.createDataFrame([("chr1",), ("2",), ("3",)], "chrom string")
    got = {r.chrom: r.contig for r in intervals.resolve_names(wanted, have).collect()}
    assert got == {"1": "chr1", "chr2": "2", "3": "3", "chrX": None}
