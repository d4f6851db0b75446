"""Lines of long contigs, cuts of long texts, and merges of whole chromosomes."""

import random
import time

import pytest

from screenlab.operators import intervals, kmers
from screenlab.sources import genome


def plain_merge(rows, gap):
    out = []
    for c, s, e in sorted(rows):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([c, s, e])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gap,width,blocks", [(0, 16, 1024), (1, 5, 3), (0, 1000, 2), (2, 1, 7)])
def test_wide_merge(spark, monkeypatch, gap, width, blocks):
    monkeypatch.setattr(intervals, "BLOCKS", blocks)
    rng = random.Random(width)
    rows = []
    for c in "abc":
        for _ in range(150):
            s = rng.randrange(3000)
            rows.append((c, s, s + rng.choice([1, 2, 5, 30, 400 if rng.random() < 0.1 else 3])))
    rows += [("d", 0, 10_000_000), ("d", 5, 6), ("d", 9_999_999, 10_000_001), ("e", 7, 8)]
    df = spark.createDataFrame(rows, "chrom string, s long, e long").repartition(5)
    assert sorted(map(tuple, intervals.merge_wide(df, ["chrom"], width, gap).collect())) == plain_merge(rows, gap)
    assert intervals.merge_wide(df.limit(0), ["chrom"], width, gap).count() == 0


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    rng = random.Random(1)
    contigs = {f"c{k}": "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 5, 60, 61, 4000]))) for k in range(30)}
    for part, names in enumerate((list(contigs)[:20], list(contigs)[20:])):
        text = "stray line\n" if part else ""
        for n in names:
            text += f">{n} a description\n"
            text += "".join(contigs[n][i : i + 60] + (" \n" if i % 7 == 0 else "\n") for i in range(0, len(contigs[n]), 60))
        (tmp_path / f"{part}.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = genome.fasta_lines(spark, str(tmp_path))
        assert lines.select("source", "block").distinct().count() > 10
        placed = genome.placed_lines(lines).collect()
        chunks = intervals.chunks_of_lines(genome.placed_lines(lines), 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {n: "" for n in contigs}
    for r in sorted(placed, key=lambda r: (r.chrom, r["at"])):
        assert r["at"] == len(got[r.chrom])
        got[r.chrom] += bytes(r.letters).decode()
    assert got == contigs
    assert all(r.piece == contigs[r.chrom][r.chunk * 100 : r.chunk * 100 + 100] for r in chunks)
    assert sum(len(r.piece) for r in chunks) == sum(map(len, contigs.values()))


def test_a_contig_of_ten_million_letters(spark, tmp_path):
    rng = random.Random(2)
    unit = "".join(rng.choice("ACGT") for _ in range(99_991))
    seq = (unit * 101)[:10_000_000]
    path = tmp_path / "long.fa"
    path.write_text(">long\n" + "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60)) + "\n")
    start = time.time()
    chunks = intervals.chunks_of_lines(genome.placed_lines(genome.fasta_lines(spark, str(path))))
    spans = [(k, "long", a, a + 500) for k, a in enumerate(rng.randrange(len(seq)) for _ in range(50))]
    got = intervals.extract(spark.createDataFrame(spans, "gene long, chrom string, s long, e long"), chunks, "gene")
    found = {r.gene: r.seq for r in got.collect()}
    assert found == {k: seq[a:b] for k, _, a, b in spans}
    whole = spark.createDataFrame([("long", seq)], "chrom string, seq string")
    assert intervals.chunks_of(whole).count() == -(-len(seq) // intervals.CHUNK)
    assert kmers.kmer_counts(whole, [], "seq", 2).count() == 16
    assert time.time() - start < 90
