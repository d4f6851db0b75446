"""Source and sink queries: the driver's tables are turned into pages, lines and
records of text first, and read back by the loaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab import schema
from screenlab.operators import screen
from screenlab.plans import roles
from screenlab.plans.registry import query, rounded
from screenlab.plans.sqltext import r
from screenlab.session import shared_folder
from screenlab.sources import genome, records, runs, sheets

CELLS = roles.CELLS
#: More than any part key, so that a page's rows are in order of order, line and part.
#: It holds 900 million orders in a bigint; more are an overflow error.
PART_STRIDE = 1_000_000_000


def _page(spark: SparkSession, data: DataFrame, header: list[str], title: str) -> DataFrame:
    """Text rows below a title row, an empty row and the header."""
    width = len(header)
    top = spark.createDataFrame(
        [(-3, title, *[None] * (width - 1)), (-2, *[None] * width), (-1, *header)],
        "row bigint, " + ", ".join(f"c{i} string" for i in range(width)),
    )
    return top.unionByName(data)


def _guide_page(spark: SparkSession, sf: str) -> DataFrame:
    """Guide library; an order's lines share an id, so later lines overwrite earlier ones."""
    data = roles.table(spark, sf, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * PART_STRIDE + F.col("l_partkey")).alias(
            "row"
        ),
        F.when(F.col("l_quantity") > 45, " ")
        .otherwise(F.concat(F.lit("G"), "l_orderkey"))
        .alias("c0"),
        F.concat(F.lit("T"), "l_partkey").alias("c1"),
        F.translate(F.col("l_partkey").cast("string"), "0123456789", "ACGTACGTAC").alias("c2"),
        F.when(F.col("l_partkey") % 4 == 0, "non-targeting")
        .otherwise(sheets.LNC_GROUP)
        .alias("c3"),
    )
    return _page(
        spark, data, ["ID", "Target", "Sequence (5' - 3')", "Target group"], "Guide library"
    )


def _annotation_page(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    data = roles.table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"),
        F.concat(F.lit("T"), "p_partkey").alias("c0"),
        F.when(size % 5 == 0, "nan").otherwise(size.cast("string")).alias("c1"),
        F.when(size % 2 == 0, "+").otherwise("-").alias("c2"),
        F.when(size % 3 == 0, None).otherwise(F.col("p_brand")).alias("c3"),
        F.when(size % 7 == 0, "n/a")
        .when(size % 7 == 1, None)
        .otherwise(F.concat(F.col("p_partkey"), F.lit(".7")))
        .alias("c4"),
    )
    header = ["lncRNA", sheets.CHROM, sheets.STRAND, sheets.NEIGHBOUR, sheets.DISTANCE]
    return _page(spark, data, header, "Annotation")


def _outcome_pages(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """One page per cell line, a column per (day, replicate)."""
    screen_rows = roles.screen(spark, sf)
    pages = {}
    for cell in CELLS:
        cells = []
        for day in schema.DAYS:
            for rep in (1, 2):
                here = (F.col("day") == day) & (F.col("rep") == rep)
                part = F.when(here, F.col("fc100"))
                value = F.try_divide(F.sum(part), F.count(part) * F.lit(100.0))
                cells.append(value.cast("string"))
        data = (
            screen_rows.where(F.col("cell") == cell)
            .groupBy(F.expr("guide div 10").alias("row"))
            .agg(*[c.alias(f"c{i + 1}") for i, c in enumerate(cells)])
        )
        data = data.select("row", F.concat(F.lit("G"), "row").alias("c0"), "c1", "c2", "c3", "c4")
        header = ["ID"] + [
            f"Day {d} Replicate {k} (Fold-change)" for d in schema.DAYS for k in (1, 2)
        ]
        pages[cell] = _page(spark, data, header, f"Outcomes {cell}")
    return pages


_GUIDES = """
, lib AS (SELECT 'G' || l_orderkey AS guide_id, 'T' || l_partkey AS target,
    translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ACGTACGTAC') AS target_sequence, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS k
  FROM lineitem WHERE l_quantity <= 45)
, tg AS (SELECT guide_id, target, target_sequence FROM lib WHERE k = 1)
, ann AS (SELECT 'T' || p_partkey AS target, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS chrom,
    CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
    CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS closest_pc_gene,
    CASE WHEN p_size % 7 > 1 THEN p_partkey END AS distance_to_closest_pc_gene FROM part)
"""


@query("load_targets", _GUIDES + "SELECT * FROM tg")
def load_targets(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.load_targets(_guide_page(spark, sf))


@query(
    "load_target_groups",
    """SELECT DISTINCT 'T' || l_partkey AS target, CASE WHEN l_partkey % 4 = 0 THEN 'non-targeting'
  ELSE 'long non-coding RNA' END AS "group" FROM lineitem""",
)
def load_target_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.load_target_groups(_guide_page(spark, sf))


@query("load_annotations", _GUIDES + "SELECT * FROM ann")
def load_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.load_annotations(_annotation_page(spark, sf))


@query(
    "header_rows",
    "SELECT 'ID' AS marker, CAST(-1 AS BIGINT) AS row UNION ALL SELECT 'absent', CAST(-3 AS BIGINT)",
)
def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    page = _guide_page(spark, sf)
    found = sheets.header_row(page, "ID").select(F.lit("ID").alias("marker"), "row")
    return found.unionByName(
        sheets.header_row(page, "absent").select(F.lit("absent").alias("marker"), "row")
    )


@query(
    "load_screen",
    _GUIDES
    + f"""
, out AS (SELECT 'G' || (guide // 10) AS guide_id, cell AS cell_line, day, rep AS replicate,
   CAST(sum(fc100) AS BIGINT) / (count(*) * 100e0) AS fold_change FROM screen GROUP BY ALL)
SELECT guide_id, cell_line, day, replicate, {r('fold_change', 'fold_change')}, coalesce(tg.target, '') AS target,
  coalesce(target_sequence, '') AS target_sequence, coalesce(chrom, '') AS chrom, coalesce(strand, '') AS strand,
  coalesce(closest_pc_gene, '') AS closest_pc_gene, distance_to_closest_pc_gene
FROM out LEFT JOIN tg USING (guide_id) LEFT JOIN ann ON ann.target = tg.target""",
    ("screen",),
)
def load_screen(spark: SparkSession, sf: str) -> DataFrame:
    targets = sheets.load_targets(_guide_page(spark, sf))
    notes = sheets.load_annotations(_annotation_page(spark, sf))
    out = sheets.load_screen(_outcome_pages(spark, sf), targets, notes)
    return out.withColumn("fold_change", rounded("fold_change"))


@query(
    "load_gene_outcomes",
    _GUIDES
    + f"""
SELECT 'T' || g.target AS target, cell AS cell_line, 14 AS day, {r('p', 'rra_pvalue')}, {r('fc', 'fold_change')},
  label, ann.chrom, strand, closest_pc_gene, distance_to_closest_pc_gene
FROM gene g JOIN ann ON ann.target = 'T' || g.target WHERE g.target % 4 <> 0 AND p < 0.9""",
    ("gene",),
)
def load_gene_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Gene pages of one day; targets of another group or without a p-value are left out."""
    gene = roles.gene(spark, sf)
    pages = {}
    for cell in CELLS:
        data = gene.where(F.col("cell") == cell).select(
            F.col("target").alias("row"),
            F.concat(F.lit("T"), "target").alias("c0"),
            F.when(F.col("p") < 0.9, F.col("p").cast("string")).alias("c1"),
            F.col("fc").cast("string").alias("c2"),
        )
        header = ["Gene", "Day 14 - P value", "Day 14 - Fold-change (log2)"]
        pages[cell] = _page(spark, data, header, f"Genes {cell}")
    groups = sheets.load_target_groups(_guide_page(spark, sf))
    notes = sheets.load_annotations(_annotation_page(spark, sf))
    out = sheets.load_rra(pages, 14, groups, notes)
    return out.withColumns(
        {"rra_pvalue": rounded("rra_pvalue"), "fold_change": rounded("fold_change")}
    )


@query(
    "records_from_json_lines",
    f"""SELECT CAST(target AS VARCHAR) AS target, cell AS cell_line, 14 AS day, {r('p', 'rra_pvalue')},
  CAST(NULL AS DOUBLE) AS fold_change, label, chrom, '' AS strand, '' AS closest_pc_gene,
  CAST(NULL AS BIGINT) AS distance_to_closest_pc_gene FROM gene""",
    ("gene",),
)
def records_from_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with an unknown field and without some known ones."""
    line = F.to_json(
        F.struct(
            F.col("target").cast("string").alias("target"),
            F.col("cell").alias("cell_line"),
            F.lit(14.0).alias("day"),
            rounded("p").alias("rra_pvalue"),
            F.col("label").cast("double").alias("label"),
            "chrom",
            F.lit("x").alias("unknown_field"),
            F.lit(1).alias("_v"),
        )
    )
    lines = roles.gene(spark, sf).select(line.alias("value"))
    return records.parse_jsonl(lines, schema.GENE_RECORD)


@query(
    "written_record_rows",
    "SELECT CAST(target AS VARCHAR) AS target, cell AS cell_line, chrom, 1 AS _v FROM gene",
    ("gene",),
)
def written_record_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a writer puts in a features file: answers left out, version stamped."""
    rows = roles.gene(spark, sf).select(
        F.col("target").cast("string").alias("target"), F.col("cell").alias("cell_line"), "chrom", "p", "fc", "label"
    )
    out = records.stamped(rows, ["p", "fc", "label"])
    return screen.assert_no_columns(out, ["p", "fc", "label"])


@query(
    "withheld_predictions",
    f"""SELECT CAST(target AS VARCHAR) AS target, cell AS cell_line, {r('score', 'y_pred_proba')} FROM preds
WHERE model = 'pvalue'""",
    ("preds",),
)
def withheld_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = roles.preds(spark, sf).where(F.col("model") == "pvalue")
    named = rows.select(
        F.col("target").cast("string").alias("target"),
        F.col("cell").alias("cell_line"),
        rounded("score").alias("y_pred_proba"),
        F.col("label").alias("y_true"),
    )
    return records.predictions(named, withheld=True)


def _gtf_lines(spark: SparkSession, sf: str) -> DataFrame:
    """GTF text of the gene models, with comments and short lines among them."""
    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    loci = roles.loci(spark, sf)
    attributes = text('gene_id "ENSG', F.col("gene"), '.3"; transcript_id "ENST', F.col("tx"), '";')
    exon = text(
        F.col("chrom"), "\tsrc\texon\t", F.col("s"), "\t", F.col("e"), "\t.\t", F.col("strand"), "\t.\t", attributes
    )
    bounds = loci.groupBy("gene").agg(
        F.min("chrom").alias("chrom"), F.min("s").alias("s"), F.max("e").alias("e"), F.min("strand").alias("strand")
    )
    named = text(
        'gene_id "ENSG', F.col("gene"), '.3"; gene_type "lncRNA"; gene_name "SYM', F.col("gene"), '";'
    )
    gene = text(
        F.col("chrom"), "\tsrc\tgene\t", F.col("s"), "\t", F.col("e"), "\t.\t", F.col("strand"), "\t.\t", named
    )
    notes = roles.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, text("#", F.col("doc_id"))).otherwise(text("a\tb")).alias("value")
    )
    return loci.select(exon.alias("value")).unionAll(bounds.select(gene.alias("value"))).unionAll(notes)


@query(
    "gtf_exon_bounds",
    """SELECT 'ENSG' || gene || '.3' AS gene, min(chrom) AS chrom, min(s) AS s, max(e) AS e, min(strand) AS strand
FROM loci GROUP BY gene""",
    ("loci",),
)
def gtf_exon_bounds(spark: SparkSession, sf: str) -> DataFrame:
    from screenlab.operators.intervals import gene_bounds

    return gene_bounds(genome.exons(genome.gtf_fields(_gtf_lines(spark, sf))))


@query(
    "gtf_gene_records",
    """SELECT 'ENSG' || gene || '.3' AS gene_id, 'ENSG' || gene AS gene_id_base, 'SYM' || gene AS gene_name,
  'lncRNA' AS gene_type, min(chrom) AS chrom FROM loci GROUP BY gene""",
    ("loci",),
)
def gtf_gene_records(spark: SparkSession, sf: str) -> DataFrame:
    return genome.gene_records(genome.gtf_fields(_gtf_lines(spark, sf)))


@query(
    "fasta_records",
    "SELECT CAST(target AS VARCHAR) AS name, seq FROM seqs WHERE seq <> ''",
    ("seqs",),
)
def fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences wrapped at 60 letters and stitched again."""
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    chunks = roles.seqs(spark, sf).select(
        F.concat(F.col("target"), F.lit(" a description\n"), wrapped, F.lit("\n")).alias("value")
    )
    return genome.fasta_records(chunks)


@query(
    "conserved_element_lines",
    """SELECT chrom, s, e, CASE WHEN element % 9 = 0 THEN 0e0 ELSE element * 1e0 END AS lod, score FROM elements""",
    ("elements",),
)
def conserved_element_lines(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("element") % 9 == 0, "none").otherwise(F.concat(F.lit("lod="), "element"))
    lines = roles.elements(spark, sf).select(
        F.concat_ws("\t", "chrom", "s", "e", name, F.col("score").cast("string")).alias("value")
    )
    return genome.conserved_elements(lines)


@query(
    "sequence_map_rows",
    """SELECT CAST(target AS VARCHAR) AS target, seq AS first_seq, '' AS last_seq FROM seqs""",
    ("seqs",),
)
def sequence_map_rows(spark: SparkSession, sf: str) -> DataFrame:
    """{gene: [sequence, ""]} JSON objects, one per line."""
    entry = F.create_map(F.col("target").cast("string"), F.array("seq", F.lit("")))
    return records.sequence_map(roles.seqs(spark, sf).select(F.to_json(entry).alias("value")))




def _wide_expression(spark: SparkSession, sf: str) -> DataFrame:
    """Wide page: some lines have a screened column, one only the parental one."""
    panel = roles.panel(spark, sf)
    def value(sample: str) -> Column:
        return F.max(F.when(F.col("sample") == sample, F.col("value"))).cast("string")

    return panel.groupBy("gene").agg(
        value("click").alias("AF"),
        value("view").alias("AF RfxCas13d"),
        value("error").alias("AO"),
        F.max(F.lit("not a number")).alias("NF RfxCas13d"),
    )


@query(
    "expression_page_panel",
    f"""
, g AS (SELECT gene, coalesce(max(CASE WHEN sample = 'view' THEN value END), 0) AS a,
   coalesce(max(CASE WHEN sample = 'error' THEN value END), 0) AS b FROM panel GROUP BY gene)
SELECT gene, 'AF' AS sample, {r('a', 'value')} FROM g UNION ALL SELECT gene, 'AO', {r('b', 'value')} FROM g
UNION ALL SELECT gene, 'NF', 0e0 FROM g""",
    ("panel",),
)
def expression_page_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The screened population's column is preferred; text reads as 0."""
    out = sheets.expression_panel(_wide_expression(spark, sf), "gene", ["AF", "AO", "NF", "RO"])
    return out.withColumn("value", rounded("value"))


@query(
    "two_page_expression",
    f"""
, a AS (SELECT * FROM panel WHERE sample <> 'click')
, b AS (SELECT gene, sample, value * 2 AS value FROM panel WHERE sample <> 'view')
SELECT gene, sample, {r('ln(1 + coalesce(a.value, b.value, 0))', 'value')} FROM a FULL JOIN b USING (gene, sample)""",
    ("panel",),
)
def two_page_expression(spark: SparkSession, sf: str) -> DataFrame:
    panel = roles.panel(spark, sf)
    first = panel.where(F.col("sample") != "click")
    second = panel.where(F.col("sample") != "view").withColumn("value", F.col("value") * 2)
    out = sheets.coalesced_panel(first, second)
    return out.withColumn("value", rounded("value"))


@query(
    "wide_matrix_rows",
    f"""SELECT sample AS gene, CAST(gene AS VARCHAR) AS sample, {r('value', 'value')} FROM panel WHERE gene IN (5, 9, 17)
UNION ALL SELECT s.sample, CAST(g.gene AS VARCHAR), NULL FROM (SELECT unnest({list(roles.SAMPLES)}) AS sample) s
CROSS JOIN (SELECT DISTINCT gene FROM panel WHERE gene IN (5, 9, 17)) g
WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.gene = g.gene AND p.sample = s.sample)""",
    ("panel",),
)
def wide_matrix_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Named models' rows of a wide matrix; "symbol (id)" headers, the first of a symbol wins."""
    cols = []
    for i, s in enumerate(roles.SAMPLES):
        value = F.max(F.when(F.col("sample") == s, F.col("value")))
        cols += [value.alias(f"{s} ({i})"), (value * 0 - 1).alias(f"{s} ({i + 100})")]
    wide = roles.panel(spark, sf).groupBy(F.col("gene").cast("string").alias("model")).agg(*cols)
    out = sheets.wide_matrix(wide, "model", ["5", "9", "17"])
    return out.withColumn("value", rounded("value"))


@query(
    "restricted_matrix",
    """SELECT user_id, event_type, value FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def restricted_matrix(spark: SparkSession, sf: str) -> DataFrame:
    wanted = roles.table(spark, sf, "orders").where(F.col("o_totalprice") > 400000).select("o_custkey")
    events = roles.table(spark, sf, "events").select("user_id", "event_type", "value")
    return sheets.restricted_matrix(events, "user_id", wanted)


@query(
    "cell_coordinates",
    f"""SELECT cell, {r('avg(fc) * 100', 'x1')}, {r('avg(p)', 'x2')} FROM gene GROUP BY cell""",
    ("gene",),
)
def cell_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinate columns PC1..PCn as one array, the first n dimensions of it."""
    table = roles.gene(spark, sf).groupBy(F.col("cell").alias("cell_line")).agg(
        F.avg("label").alias("PC10"),
        (F.avg("fc") * 100).alias("PC1"),
        F.avg("p").alias("PC2"),
    )
    out = sheets.coordinates(table, "PC", 2)
    return out.select(
        "cell",
        rounded(F.get("vec", F.lit(0))).alias("x1"),
        rounded(F.get("vec", F.lit(1))).alias("x2"),
    )


# ---- runs -----------------------------------------------------------------------------


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as run infos, their lines as metric rows; some runs lack one half."""
    orders = roles.table(spark, sf, "orders")
    infos = orders.where(F.col("o_orderpriority") != "5-LOW").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("run"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("cell_line"),
    )
    lines = roles.table(spark, sf, "lineitem")
    metrics = lines.groupBy(
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("run"),
        F.concat("l_returnflag", "l_linestatus").alias("split"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / (F.count(F.lit(1)) * 100.0)).alias("rho"),
    )
    return infos, metrics


_RUNS = """
, infos AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run, o_orderpriority AS model, o_orderstatus AS cell_line
   FROM orders WHERE o_orderpriority <> '5-LOW')
, metrics AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS run, l_returnflag || l_linestatus AS split,
   count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100e0) AS rho
   FROM lineitem GROUP BY ALL)
"""


@query(
    "complete_runs",
    _RUNS + f"SELECT run, split, n, {r('rho', 'rho')}, model, cell_line FROM metrics JOIN infos USING (run)",
)
def complete_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.complete_runs(*_runs(spark, sf))
    return out.withColumn("rho", rounded("rho"))


@query(
    "latest_runs",
    _RUNS + "SELECT model, cell_line, max(run) AS run FROM infos GROUP BY model, cell_line",
)
def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest_runs(_runs(spark, sf)[0], ["model", "cell_line"])


@query(
    "run_summary",
    _RUNS
    + "SELECT run, "
    + ", ".join(
        f"max(CASE WHEN split = '{s}' THEN n END) AS n_{s}, "
        + r(f"max(CASE WHEN split = '{s}' THEN rho END)", f"rho_{s}")
        for s in CELLS
    )
    + " FROM metrics GROUP BY run",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = runs.run_summary(_runs(spark, sf)[1], CELLS, ["n", "rho"])
    return out.withColumns({f"rho_{s}": rounded(f"rho_{s}") for s in CELLS})


@query(
    "pooled_against_own",
    f"""
, pooled AS (SELECT cell, count(*) AS n, avg(label) AS rate FROM gene GROUP BY cell)
, own AS (SELECT cell, avg(label) AS rate FROM gene WHERE length(chrom) = 2 AND cell <> 'RO' GROUP BY cell)
SELECT cell, n AS n_test, {r('pooled.rate', 'pooled_rate')}, {r('own.rate', 'own_rate')},
  {r('own.rate - pooled.rate', 'delta_rate')} FROM pooled LEFT JOIN own USING (cell)""",
    ("gene",),
)
def pooled_against_own(spark: SparkSession, sf: str) -> DataFrame:
    """Two metric tables side by side; a group without its own model has NULLs."""
    gene = roles.gene(spark, sf)
    pooled = gene.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"))
    part = gene.where((F.length("chrom") == 2) & (F.col("cell") != "RO"))
    own = part.groupBy("cell").agg(F.avg("label").alias("rate"))
    out = runs.pooled_against_own(pooled, own, "cell", "rate")
    return out.withColumns({c: rounded(c) for c in ("pooled_rate", "own_rate", "delta_rate")})


@query(
    "written_run_tables",
    """SELECT 'a' AS run_id, count(*) AS n, CAST(sum(target) AS BIGINT) AS targets FROM gene WHERE cell = 'RO'
UNION ALL SELECT 'b', count(*), CAST(sum(target) AS BIGINT) FROM gene WHERE cell = 'RF'""",
    ("gene",),
)
def written_run_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two runs read back; the first run was written twice, and only its last tables stay."""
    folder, gene = shared_folder(spark), roles.gene(spark, sf)
    empty = spark.createDataFrame([], "n long")
    for run, cell in (("a", "AF"), ("b", "RF"), ("a", "RO")):
        rows = gene.where(F.col("cell") == cell).select("target", "cell", "label")
        records.write_run(folder, run, empty, empty, spark.createDataFrame([(cell,)], "params string"), rows)
    out = spark.read.parquet(f"{folder}/predictions")
    return out.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("targets"))
