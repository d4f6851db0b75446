"""Files: records, pages, GTF, FASTA, runs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from screenlab import schema
from screenlab.plans import loading
from screenlab.sources import genome, records, runs, sheets


def test_record_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("T1", "K562", 14, 0.01, -0.5, 1, "1", "+", "GENE", 500), ("T2", "THP1", 14, 0.5, 0.1, 0, "2", "-", "", None)]
    df = spark.createDataFrame(
        rows,
        "target string, cell_line string, day int, rra_pvalue double, fold_change double, label int,"
        " chrom string, strand string, closest_pc_gene string, distance_to_closest_pc_gene long",
    )
    records.write_jsonl(df, path)
    back = records.read_jsonl(spark, path, schema.GENE_RECORD)
    assert back.dtypes == df.dtypes and back.exceptAll(df).isEmpty() and back.count() == 2
    records.write_jsonl(df, path, ("label", "fold_change"))
    text = spark.read.text(path).first().value
    assert "label" not in text and json.loads(text)["_v"] == 1
    assert records.read_jsonl(spark, path, schema.GENE_RECORD).where("label IS NOT NULL").isEmpty()


def test_reader_is_tolerant(spark, tmp_path):
    file = tmp_path / "x.jsonl.gz"
    with gzip.open(file, "wt") as out:
        out.write('{"target": "T1", "day": 14.0, "unknown": [1]}\n\n{"target": "T2", "day": 7}\n')
    got = {r.target: r for r in records.read_jsonl(spark, str(file), schema.GENE_RECORD).collect()}
    assert got["T1"].day == 14 and got["T2"].day == 7
    assert got["T1"].chrom == "" and got["T1"].label is None and len(got) == 2


def page(spark, *rows):
    width = max(len(r) for r in rows)
    full = [(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "row long, " + ", ".join(f"c{i} string" for i in range(width)))


def library(spark):
    return page(
        spark,
        ("Title",),
        (),
        ("ID", "Target", "Sequence (5' - 3')", "Target group"),
        ("g1", "L1", "ACGT", "long non-coding RNA"),
        ("g2", "P1", "CCCC", "protein-coding gene"),
        (" ", "L9", "AAAA", "long non-coding RNA"),
        ("g1", "L2", "GGGG", "long non-coding RNA"),
    )


def test_targets(spark):
    got = {r.guide_id: (r.target, r.target_sequence) for r in sheets.load_targets(library(spark)).collect()}
    assert got == {"g1": ("L2", "GGGG"), "g2": ("P1", "CCCC")}
    narrow = page(spark, ("ID", "Target", "Sequence"), ("g1", "L1", "ACGT"))
    assert sheets.load_target_groups(narrow).isEmpty()


def test_screen_pages(spark):
    header = ("ID", *[f"Day {d} Replicate {r} (Fold-change)" for d in (7, 14) for r in (1, 2)])
    body = [("g1", "1", "2", "3", "4"), ("g2", "5", None, "7", "8")]
    pages = {c: page(spark, ("x",), header, *body) for c in schema.CELL_LINES}
    notes = page(
        spark,
        ("lncRNA", "ENSEMBL_ID", "Chr", "Strand", sheets.NEIGHBOUR, sheets.DISTANCE),
        ("L2", "E1", "1", "+", "nan", "1200.0"),
        ("P1", "E2", "nan", "-", "G", "far"),
    )
    out = sheets.load_screen(pages, sheets.load_targets(library(spark)), sheets.load_annotations(notes))
    assert out.count() == 35  # 2 guides x 5 lines x 4 columns, one cell empty
    row = out.where("guide_id = 'g1' AND cell_line = 'THP1' AND day = 14 AND replicate = 2").first()
    assert (row.fold_change, row.target, row.chrom, row.closest_pc_gene, row.distance_to_closest_pc_gene) == (4.0, "L2", "1", "", 1200)
    other = out.where("guide_id = 'g2'").first()
    assert (other.chrom, other.closest_pc_gene, other.distance_to_closest_pc_gene) == ("", "G", None)


def test_gene_pages(spark):
    header = ("Gene", "Day 14 - P value", "Day 14 - Fold-change (log2)")
    body = [("L2", "0.02", "-0.9"), ("P1", "0.001", "-3"), ("L9", "0.01", None)]
    pages = {c: page(spark, header, *body) for c in schema.CELL_LINES}
    out = sheets.load_rra(pages, 14, sheets.load_target_groups(library(spark)))
    assert out.count() == 5 and {r.label for r in out.collect()} == {1}
    with pytest.raises(ValueError, match="day 7"):
        sheets.load_rra(pages, 7, sheets.load_target_groups(library(spark)))


def test_page_from_csv(spark, tmp_path):
    file = tmp_path / "p.csv"
    file.write_text("0,ID,Target\n1,g1,T1\n")
    got = sheets.body(sheets.read_page(spark, str(file)), "ID").first()
    assert (got["ID"], got["Target"]) == ("g1", "T1")


def test_fold_change_headers():
    import re

    for text, found in (
        ("Day 14_Rep 1 (Fold-change)", ("14", "1")),
        ("Day 7 Rep 2 log2 (Fold-change)", ("7", "2")),
        ("day 7 replicate 1 (fold-change)", ("7", "1")),
        ("Day 7 - P value", None),
    ):
        match = re.search(sheets.FOLD_CHANGE, text)
        assert (match.groups() if match else None) == found


def test_gtf_and_fasta_files(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    line = '1\tsrc\texon\t{}\t{}\t.\t+\t.\tgene_id G1; transcript_id T1;\n'
    gtf.write_text("# note\n" + line.format(5, 9) + line.format(1, 3) + "short\tline\n")
    exons = genome.exons(genome.read_gtf(spark, str(gtf)))
    assert sorted((r.gene, r.tx, r.s, r.e) for r in exons.collect()) == [("G1", "T1", 1, 3), ("G1", "T1", 5, 9)]
    fasta = tmp_path / "a.fa"
    fasta.write_text(">one first\nACG\nT\n>two a>b note\nGG\n\nCC\n")
    got = {r.name: r.seq for r in genome.read_fasta(spark, str(fasta)).collect()}
    assert got == {"one": "ACGT", "two": "GGCC"}


def test_runs_need_both_halves(spark, tmp_path):
    for name, info, metrics in (("r1", True, True), ("r2", True, False), ("r3", False, True)):
        folder = tmp_path / name
        folder.mkdir()
        if info:
            (folder / "run_info.json").write_text(json.dumps({"model": "m", "k": 3}))
        if metrics:
            (folder / "metrics.csv").write_text("split,auprc\nOverall,0.5\n")
    got = runs.complete_runs(*runs.read_runs(spark, str(tmp_path))).collect()
    assert [(r.run, r.model, r.split, r.auprc) for r in got] == [("r1", "m", "Overall", "0.5")]


def test_run_bundle(spark, tmp_path):
    one = spark.createDataFrame([(1.0,)], "v double")
    for run in ("a", "b", "a"):
        records.write_run(str(tmp_path / "runs"), run, one, one, one, one)
    back = spark.read.parquet(str(tmp_path / "runs" / "metrics"))
    assert sorted(r.run_id for r in back.collect()) == ["a", "b"]


def test_wide_matrix_takes_the_first_of_a_symbol(spark):
    df = spark.createDataFrame([("m1", 1.0, 2.0), ("m2", 3.0, 4.0)], "id string, `A (1)` double, `A (2)` double")
    got = sheets.wide_matrix(df, "id", ["m2"]).collect()
    assert [(r.gene, r.sample, r.value) for r in got] == [("A", "m2", 3.0)]


def test_withheld_truth_is_absent(spark):
    df = spark.createDataFrame([("t", "c", 0.5, 1)], "target string, cell_line string, y_pred_proba double, y_true int")
    assert "y_true" not in records.predictions(df, withheld=True).columns
    assert "y_true" in records.predictions(df, withheld=False).columns


def test_first_number(spark):
    from screenlab.functions import maths as fm

    texts = {"score: -3.5e2 done": -350.0, "B12 7": 7.0, "none": None, "x1 y2": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in df.select("t", fm.first_number(F.col("t")).alias("v")).collect()}
    assert got == texts


def test_the_last_line_of_an_order_names_its_target(spark, tmp_path):
    """Also where the parts of an order lie more than a million apart."""
    lines = [(1, 1, 1_200_000, 5), (1, 2, 7, 5), (2, 1, 3, 5), (2, 1, 2_000_000, 5)]
    kind = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity int"
    spark.createDataFrame(lines, kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.guide_id: r.target for r in loading.load_targets(spark, str(tmp_path)).collect()}
    assert got == {"G1": "T7", "G2": "T2000000"}
