"""Sequence functions, k-mers and guides on hand-computed values."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from screenlab.operators import guides as go
from screenlab.plans import roles
from screenlab.functions import seq as fs
from screenlab.operators import features, guides, kmers


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, want", [("", 0), ("A", 1), ("ACGT", 1), ("AACCCG", 3), ("GGGGG", 5), ("ANNNT", 3)]
)
def test_homopolymer(spark, text, want):
    assert value(spark, text, fs.longest_homopolymer(F.col("s"))) == want


def test_reverse_complement_keeps_case_and_n(spark):
    assert value(spark, "AaCcGgTtNn", fs.reverse_complement(F.col("s"))) == "nNaAcCgGtT"


def aligned_run(s):
    """Longest run of equal letters over every alignment of s and its other strand."""
    rc = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    best = 0
    for i, j in itertools.product(range(len(s)), repeat=2):
        n = 0
        while i + n < len(s) and j + n < len(s) and s[i + n] == rc[j + n]:
            n += 1
        best = max(best, n)
    return best


@pytest.mark.parametrize("text", ["", "A", "AT", "ACGT", "AAAAAA", "GGGAAACCC", "ACGTTGCATNACGGATCCA"])
def test_self_complement_run(spark, text):
    assert value(spark, text, fs.self_complement_run(F.col("s"))) == aligned_run(text)


def test_short_text_has_no_windows(spark):
    assert value(spark, "AC", fs.windows(F.col("s"), 3)) == []
    assert value(spark, "ACGTA", fs.windows(F.col("s"), 3)) == ["ACG", "CGT", "GTA"]
    assert value(spark, "AC", fs.self_complement_share(F.col("s"))) == 0.0


def test_occurrences_do_not_overlap(spark):
    assert value(spark, "AAAAA", fs.occurrences(F.col("s"), F.lit("AA"))) == 2
    assert value(spark, "AAAAA", fs.first_position(F.col("s"), F.lit("C"))) == -1


def counts(spark, seqs, k, spread=False):
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    return {(r.id, r.kmer): r.n for r in kmers.kmer_counts(df, ["id"], "seq", k, spread).collect()}


def test_kmers_skip_other_letters_and_short_text(spark):
    assert counts(spark, ["ACGNACG", "NNNNN", "AC"], 3) == {(0, "ACG"): 2}


@pytest.mark.parametrize("spread", [False, True])
def test_kmers_across_chunk_borders(spark, monkeypatch, spread):
    monkeypatch.setattr(kmers, "CHUNK", 5)
    text = "ACGTTGCAACGTNACGGT"
    want = {}
    for i in range(len(text) - 2):
        w = text[i : i + 3]
        if "N" not in w:
            want[(0, w)] = want.get((0, w), 0) + 1
    assert counts(spark, [text], 3, spread) == want


def test_vocabulary_and_fit(spark):
    assert [r.kmer for r in kmers.vocabulary(spark, 2).orderBy("idx").collect()] == [
        a + b for a in "ACGT" for b in "ACGT"
    ]
    df = spark.createDataFrame([("AAAAAA",)], "seq string")
    assert [r.kmer for r in kmers.fit_vocab(df, "seq", 3).collect()] == ["AAA"]
    assert kmers.fit_vocab(df.where("false"), "seq", 3).count() == 0


def test_denominator_counts_vocabulary_windows_only(spark):
    df = spark.createDataFrame([(1, "AAATTT")], "id long, seq string")
    vocab = spark.createDataFrame([("AAA",), ("TTT",)], "kmer string")
    got = {r.kmer: r.value for r in kmers.kmer_frequencies(df, ["id"], "seq", 3, vocab).collect()}
    assert got == {"AAA": 0.5, "TTT": 0.5}
    missing = spark.createDataFrame([("CCC",)], "kmer string")
    assert kmers.kmer_frequencies(df, ["id"], "seq", 3, missing).count() == 0


def signed(spark, spacer, body):
    g = spark.createDataFrame([(1, 7, spacer)], "guide_id long, target long, spacer string")
    b = spark.createDataFrame([(7, body)], "target long, seq string")
    return {r.kmer: r.value for r in kmers.signed_overlap(g, b, 3).collect()}


def test_signed_overlap(spark):
    got = signed(spark, "AAACCC", "ACGTGGGTTTACGTNAAAAAAAAAA")
    assert all(got[k] < 0 for k in ("GGG", "GGT", "GTT", "TTT")) and got["AAA"] > 0
    assert all(v > 0 for v in signed(spark, "AAACCC", "ACGTACGTACGTNCCCCCCCCCC").values())


def test_screen_feature_table(spark):
    rows = [(1, 5, "AAAAAA", 7, "x", 500), (2, 5, "NNNNNN", 14, "unknown", None)]
    df = spark.createDataFrame(rows, "record long, target long, spacer string, day int, cell string, distance int")
    got = {
        (r.record, r.feature): r.value
        for r in features.screen_features(df, 3, (7, 14), ("x", "y")).collect()
    }
    assert got == {
        (1, "guide_AAA"): 1.0,
        (1, "day_7"): 1.0,
        (1, "cell_x"): 1.0,
        (1, "distance"): 500.0,
        (2, "day_14"): 1.0,
        (2, "distance"): -1.0,
    }


def test_rows_without_a_vector_get_zeros(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "cell string")
    vec = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "cell string, vec array<double>")
    got = {r.cell: r.vec for r in features.vector_or_zero(rows, "cell", vec, 2).collect()}
    assert got == {"a": [1.0, 2.0], "b": [0.0, 0.0]}


def test_constant_dimension_is_left_at_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, vec array<double>")
    got = {r.id: r.vec for r in features.standardise(df, df, 2).collect()}
    assert got == {1: [-1.0, 0.0], 2: [1.0, 0.0]}


def test_pca_needs_enough_training_rows(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(6)], "id long, vec array<double>")
    assert len(features.reduce_pca(df, df, 3, 2).first().vec) == 2
    with pytest.raises(ValueError, match="training rows"):
        features.reduce_pca(df, df.limit(1), 3, 2)


def test_variance_counts_absent_entries(spark):
    long = spark.createDataFrame([("f", 2.0), ("f", 4.0)], "feature string, value double")
    got = features.variances(long, F.lit(4)).first().variance
    assert got == pytest.approx(2.75)  # of 2, 4, 0, 0


def test_unknown_block_is_an_error(spark):
    long = spark.createDataFrame([("a", 1.0)], "block string, value double")
    with pytest.raises(KeyError, match="unknown blocks"):
        features.pick_blocks(long, ["b"], ["a"])


def test_guide_site_and_flanks(spark):
    transcript = "TTTTTACGTACGTACGTACGTACGTACGGGGG"
    site = transcript[5:28]
    spacer = site.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    g = spark.createDataFrame([(1, 7, spacer)], "guide_id long, target long, spacer string")
    t = spark.createDataFrame([(7, transcript)], "target long, seq string")
    row = guides.guide_sites(g, t).first()
    assert row["at"] == 5 and row.exact_match_count == 1
    assert row["flank_-1"] == "T" and row["flank_+1"] == transcript[28]
    assert row.context == transcript


def test_sites_of_a_long_text_in_linear_steps(spark, tmp_path):
    """A guide costs no walk through its text for each cut: a million letters take seconds."""
    import random
    import time

    text = "".join(random.Random(4).choices("ACGT", k=1_000_000))
    spark.createDataFrame([(7, text + " ä!"), (8, None), (9, "")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    start = time.monotonic()
    own = roles.seqs(spark, str(tmp_path))
    sites = go.guide_sites(roles.guides(spark, str(tmp_path)), own).collect()
    took = time.monotonic() - start
    # a base of the text stands for itself only as far as the table of letters says so
    dna = next(r.seq for r in own.collect() if r.target == 7)
    assert len(dna) == len(text) and {r.target: r.seq for r in own.collect() if r.target != 7} == {8: None, 9: ""}
    assert len(sites) == (len(text) - 23) // 151 + 1
    for r in sites:
        i = r.guide_id - 7_000_000
        rc = r.spacer[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert (rc if i % 2 else r.spacer) == dna[151 * i : 151 * i + 23]
        assert r.at == dna.find(rc) and r.exact_match_count == dna.count(rc)
        if r.at >= 0:
            assert r.context == dna[max(r.at - 50, 0) : r.at + 73]
            assert r["flank_+1"] == (dna[r.at + 23 : r.at + 24] or None)
    assert took < 30


def test_pieces_of_long_and_short_texts_count_as_one(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 5)
    monkeypatch.setattr(kmers, "AT_ONCE", 8)
    texts = {1: "ACGTNACGTACCA", 2: "AC", 3: "", 4: "GGGGGGGGGGé", 5: "acgACG"}
    df = spark.createDataFrame([*texts.items(), (6, None)], "id int, seq string")
    for k in (1, 2, 3):
        want = {}
        for t, s in texts.items():
            for i in range(len(s) - k + 1):
                if set(s[i : i + k]) <= set("ACGT"):
                    want[t, s[i : i + k]] = want.get((t, s[i : i + k]), 0) + 1
        got = kmers.kmer_counts(df, ["id"], "seq", k).collect()
        assert {(r.id, r.kmer): r.n for r in got} == want and len(got) == len(want)


def test_no_window_becomes_a_row_and_copies_of_a_guide_share_their_kmers(spark):
    bodies = spark.createDataFrame([(1, "ACGTAC")], "target int, seq string")
    guides = spark.createDataFrame([(7, 1, "GTA"), (7, 1, "CGT"), (8, 1, "AAA")], "guide_id int, target int, spacer string")
    plan = kmers.kmer_counts(bodies, ["target"], "seq", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate explode") == 1  # pieces, not windows
    got = sorted((r.guide_id, r.kmer, r.value) for r in kmers.signed_overlap(guides, bodies, 3).collect())
    copies = [(7, "ACG", -0.25), (7, "CGT", 0.25), (7, "GTA", 0.25), (7, "TAC", -0.25)]
    assert got == sorted(copies * 2 + [(8, x, 0.25) for x in ("ACG", "CGT", "GTA", "TAC")])


@pytest.mark.parametrize("k", [2, 3, 4])
def test_overlap_sums_are_those_of_the_entries(spark, k):
    rng = random.Random(k)
    spacers = [(g, g % 4, "".join(rng.choice("ACGTN" if g % 5 == 0 else "ACGT") for _ in range(rng.randint(0, 23)))) for g in range(60)]
    spacers += [spacers[7], (8, 0, "GGGTTTT"), (90, 9, "ACGT"), (91, 1, None), (92, 1, "acgtacgt")]
    guides = spark.createDataFrame(spacers, "guide_id int, target int, spacer string").repartition(3)
    bodies = [(t, "".join(rng.choice("ACGTN") for _ in range(40))) for t in range(3)] + [(3, "N")]
    bodies = spark.createDataFrame(bodies, "target int, seq string")
    vocab = kmers.fit_vocab(bodies.where("target < 2"), "seq", k)
    for v in (None, vocab):
        want = {}
        for r in kmers.signed_overlap(guides, bodies, k, v).collect():
            want.setdefault((r.guide_id, r.target), []).append(r.value)
        out = kmers.signed_overlap_sums(guides, bodies, k, v)
        got = {(r.guide_id, r.target): (r.features, r.negated, round(r.total, 9), r.lo) for r in out.collect()}
        assert got == {g: (len(x), sum(y < 0 for y in x), round(sum(x), 9), min(x)) for g, x in want.items() if x}


def test_block_totals_are_those_of_the_entries(spark):
    rows = [(1, 7, "ACGTACGT", 7, "x", 5), (2, 8, "ACGTACGT", 14, "z", None), (2, 8, "TTTTACG", 14, "z", None), (3, 9, "NN", 7, "y", 0)]
    df = spark.createDataFrame(rows, "record int, target int, spacer string, day int, cell string, distance int")
    bodies = spark.createDataFrame([(7, "AACCG", "GGT"), (9, "AN", "ACA")], "target int, first_seq string, last_seq string")
    vectors = spark.createDataFrame([(7, [0.5, 0.0, -2.0]), (8, [1.0])], "target int, vec array<double>")
    args = (2, (7, 14), ("x", "y"), bodies)
    want = {}
    for r in features.screen_features(df, *args, body_vectors=vectors).collect():
        want.setdefault((r.record, r.block), []).append((r.feature, r.value))
    out = features.screen_block_totals(df, *args, vectors)
    got = {(r.record, r.block): (r.n, round(r.total, 9), r["last"], r.top) for r in out.collect()}
    assert got == {
        k: (len(v), round(sum(x for _, x in v), 9), max(f for f, _ in v), max(x for _, x in v)) for k, v in want.items()
    }
