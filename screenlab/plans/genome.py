"""Interval and genomic-coordinate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators import intervals as io
from screenlab.operators.ordered import first_by
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all
from screenlab.plans.sqltext import r
from screenlab.sources import genome

BIN = 64
#: Letters at each end of a gene.
END = 1000


def _merge_sql(src: str, by: str, out: str, gap: int = 0) -> str:
    return f"""
, {out}_a AS (SELECT {by}, s, e, max(e) OVER (PARTITION BY {by} ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src})
, {out}_b AS (SELECT *, sum(CASE WHEN s <= pe + {gap} THEN 0 ELSE 1 END)
    OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM {out}_a)
, {out} AS (SELECT {by}, min(s) AS s, max(e) AS e FROM {out}_b GROUP BY {by}, isl)
"""


@query(
    "merge_exons",
    _merge_sql("exons", "gene, chrom", "m") + "SELECT gene, chrom, s, e FROM m",
    ("exons",),
)
def merge_exons(spark: SparkSession, sf: str) -> DataFrame:
    return io.merge(roles.exons(spark, sf).select("gene", "chrom", "s", "e"), ["gene", "chrom"])


@query(
    "merge_closed_adjacent",
    _merge_sql("loci", "gene", "m", 1) + "SELECT gene, s, e FROM m",
    ("loci",),
)
def merge_closed_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    return io.merge(roles.loci(spark, sf).select("gene", "s", "e"), ["gene"], gap=1)


@query(
    "merge_by_chromosome",
    _merge_sql("elements", "chrom", "m") + "SELECT chrom, s, e FROM m",
    ("elements",),
)
def merge_by_chromosome(spark: SparkSession, sf: str) -> DataFrame:
    """Few, large groups: merged in tiles first."""
    return io.merge_wide(roles.elements(spark, sf).select("chrom", "s", "e"), ["chrom"], 1024)


@query(
    "interval_overlap_pairs",
    """SELECT x.gene, x.tx, x.s, x.e, y.element, least(x.e, y.e) - greatest(x.s, y.s) AS overlap
FROM exons x JOIN elements y ON x.chrom = y.chrom AND x.s < y.e AND y.s < x.e""",
    ("exons", "elements"),
)
def interval_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    exons = roles.exons(spark, sf).select("gene", "tx", "chrom", "s", "e")
    pairs = io.overlap_join(exons, roles.elements(spark, sf), ["chrom"], BIN)
    return pairs.select("gene", "tx", "s", "e", F.col("r_element").alias("element"), "overlap")


@query(
    "elements_over_exons",
    """SELECT DISTINCT y.element, y.chrom, y.s, y.e FROM elements y
WHERE EXISTS (SELECT 1 FROM exons x WHERE x.chrom = y.chrom AND x.s < y.e AND y.s < x.e)""",
    ("exons", "elements"),
)
def elements_over_exons(spark: SparkSession, sf: str) -> DataFrame:
    elements = roles.elements(spark, sf).select("element", "chrom", "s", "e")
    return io.overlapping(elements, roles.exons(spark, sf), ["chrom"], BIN)


@query(
    "conservation",
    _merge_sql("exons", "gene, chrom", "m")
    + f"""
, ov AS (SELECT m.gene, y.element, y.score, y.lod, least(m.e, y.e) - greatest(m.s, y.s) AS o
  FROM m JOIN elements y ON m.chrom = y.chrom AND m.s < y.e AND y.s < m.e)
, h AS (SELECT gene, sum(o) AS covered, count(DISTINCT element) AS hit, max(score) AS mx,
   sum(score * o) AS w, max(lod) AS ml FROM ov GROUP BY gene)
, x AS (SELECT gene, sum(e - s) AS exonic FROM m GROUP BY gene)
SELECT gene, {r('coalesce(covered / exonic, 0)', 'cons_frac')}, coalesce(hit, 0) AS cons_n,
  {r('coalesce(mx, 0)', 'cons_max', 8)}, {r('coalesce(w / covered, 0)', 'cons_mean', 8)},
  {r('coalesce(ml, 0)', 'cons_maxlod')}
FROM x LEFT JOIN h USING (gene)""",
    ("exons", "elements"),
)
def conservation(spark: SparkSession, sf: str) -> DataFrame:
    out = io.conservation(roles.exons(spark, sf), roles.elements(spark, sf), BIN)
    return round_all(round_all(out, ["cons_frac", "cons_maxlod"]), ["cons_max", "cons_mean"], 8)


@query(
    "transcript_architecture",
    _merge_sql("exons", "gene", "m", 1)
    + f"""
, t AS (SELECT gene, tx, sum(e - s + 1) AS len, count(*) AS ne FROM exons GROUP BY gene, tx)
, g AS (SELECT gene, count(*) AS nt, max(len) AS lo, avg(len) AS me, min(len) AS sh,
   stddev_pop(len) AS sd, avg(ne) AS mx, max(ne) AS xx, stddev_pop(ne) AS sx FROM t GROUP BY gene)
, u AS (SELECT gene, sum(e - s + 1) AS un, max(e) - min(s) + 1 AS sp FROM m GROUP BY gene)
SELECT gene, {r('ln(1 + nt)', 'log_transcript_count')}, {r('ln(1 + lo)', 'log_longest_exonic_length')},
  {r('ln(1 + me)', 'log_mean_exonic_length')}, {r('ln(1 + sh)', 'log_shortest_exonic_length')},
  {r('sd / me', 'transcript_length_cv')}, {r('lo / me', 'longest_to_mean_length')},
  {r('mx', 'mean_exon_count')}, {r('xx', 'max_exon_count')}, {r('sx / mx', 'exon_count_cv')},
  {r('ln(1 + un)', 'log_union_exonic_bp')}, {r('ln(1 + sp)', 'log_genomic_span')},
  {r('un / lo', 'union_to_longest_ratio')} FROM g JOIN u USING (gene)""",
    ("exons",),
)
def transcript_architecture(spark: SparkSession, sf: str) -> DataFrame:
    out = io.architecture(roles.exons(spark, sf))
    return round_all(out, [c for c in out.columns if c != "gene"])


@query(
    "gene_bounds",
    """SELECT gene, min(chrom) AS chrom, min(s) AS s, max(e) AS e, min(strand) AS strand
FROM loci GROUP BY gene""",
    ("loci",),
)
def gene_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return io.gene_bounds(roles.loci(spark, sf))


@query(
    "longest_transcript",
    """SELECT gene, tx, CAST(bases AS BIGINT) AS bases FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY bases DESC, tx) AS k FROM (
    SELECT gene, tx, sum(e - s + 1) AS bases FROM exons GROUP BY gene, tx)) WHERE k = 1""",
    ("exons",),
)
def longest_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return io.longest_transcript(roles.exons(spark, sf))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the contigs, from their FASTA lines."""
    return io.chunks_of_lines(genome.placed_lines(roles.contig_lines(spark, sf)))


@query(
    "fasta_line_places",
    """, l AS (SELECT chrom, seq, unnest(range(0, (length(seq) + 59) // 60)) AS i FROM contigs WHERE seq <> '')
SELECT chrom, CAST(i * 60 AS BIGINT) AS at, substring(seq, (i * 60 + 1)::BIGINT, 60) AS line FROM l""",
    ("contigs",),
)
def fasta_line_places(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence line of one FASTA file, with its record and its place there."""
    lines = genome.placed_lines(roles.contig_lines(spark, sf))
    return lines.select("chrom", "at", F.col("letters").cast("string").alias("line"))


_BOUNDS = """
, b AS (SELECT gene, min(chrom) AS chrom, min(s) AS s, max(e) AS e, min(strand) AS strand
  FROM loci GROUP BY gene)
"""


@query(
    "gene_span_sequences",
    _BOUNDS
    + """SELECT gene, CASE WHEN strand = '-'
    THEN reverse(translate(substring(c.seq, s, e - s + 1), 'ACGT', 'TGCA'))
    ELSE substring(c.seq, s, e - s + 1) END AS seq FROM b JOIN contigs c USING (chrom)""",
    ("loci", "contigs"),
)
def gene_span_sequences(spark: SparkSession, sf: str) -> DataFrame:
    bounds = io.gene_bounds(roles.loci(spark, sf))
    return io.span_sequences(bounds, _chunks(spark, sf))


@query(
    "gene_end_windows",
    _BOUNDS
    + f"""
, w AS (SELECT gene, strand, substring(c.seq, s, least(e - s + 1, {END})) AS l,
    substring(c.seq, greatest(s, e - {END} + 1), least(e - s + 1, {END})) AS rt
  FROM b JOIN contigs c USING (chrom))
SELECT gene, CASE WHEN strand = '-' THEN reverse(translate(rt, 'ACGT', 'TGCA')) ELSE l END AS first_window,
  CASE WHEN strand = '-' THEN reverse(translate(l, 'ACGT', 'TGCA')) ELSE rt END AS last_window FROM w""",
    ("loci", "contigs"),
)
def gene_end_windows(spark: SparkSession, sf: str) -> DataFrame:
    bounds = io.gene_bounds(roles.loci(spark, sf))
    return io.end_windows(bounds, _chunks(spark, sf), END)


@query(
    "spliced_sequences",
    """
, best AS (SELECT gene, tx FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY bases DESC, tx) AS k
   FROM (SELECT gene, tx, sum(e - s + 1) AS bases FROM loci GROUP BY gene, tx)) WHERE k = 1)
, j AS (SELECT gene, any_value(strand) AS strand,
    string_agg(substring(c.seq, s, e - s + 1), '' ORDER BY s) AS q
  FROM loci JOIN best USING (gene, tx) JOIN contigs c USING (chrom) GROUP BY gene)
SELECT gene, CASE WHEN strand = '-' THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS seq FROM j""",
    ("loci", "contigs"),
)
def spliced_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return io.spliced_sequences(roles.loci(spark, sf), _chunks(spark, sf))


@query(
    "contig_name_resolution",
    """
, w AS (SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'chr' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS chrom FROM customer)
, h AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'chr' || n_nationkey ELSE CAST(n_nationkey AS VARCHAR) END AS name
   FROM nation WHERE n_nationkey % 5 <> 4)
SELECT w.chrom, coalesce(a.name, b.name) AS contig FROM w LEFT JOIN h a ON a.name = w.chrom
LEFT JOIN h b ON b.name = CASE WHEN starts_with(w.chrom, 'chr') THEN substring(w.chrom, 4) ELSE 'chr' || w.chrom END""",
)
def contig_name_resolution(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_nationkey").cast("string")
    wanted = roles.table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("chr"), key))
        .otherwise(key)
        .alias("chrom")
    )
    name = F.col("n_nationkey").cast("string")
    have = (
        roles.table(spark, sf, "nation")
        .where(F.col("n_nationkey") % 5 != 4)
        .select(
            F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("chr"), name))
            .otherwise(name)
            .alias("chrom")
        )
    )
    return io.resolve_names(wanted.distinct(), have)


@query(
    "coordinate_conversion",
    """SELECT gene, tx, s - 1 AS s0, e AS e0, (s - 1) + 1 AS s1, e - (s - 1) AS bases FROM loci""",
    ("loci",),
)
def coordinate_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Closed to half-open and back, with the length that both agree on."""
    s0, e0 = io.to_half_open(F.col("s"), F.col("e"))
    half = roles.loci(spark, sf).select("gene", "tx", s0.alias("s0"), e0.alias("e0"))
    s1, _ = io.to_closed(F.col("s0"), F.col("e0"))
    return half.select(
        "gene", "tx", "s0", "e0", s1.alias("s1"), (F.col("e0") - F.col("s0")).alias("bases")
    )


@query(
    "preferred_symbol_map",
    """
, m AS (SELECT p_brand AS symbol, p_partkey AS id, p_type LIKE '%BRASS' AS coding FROM part)
SELECT symbol, id FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coding DESC, id) AS k FROM m)
WHERE k = 1""",
)
def preferred_symbol_map(spark: SparkSession, sf: str) -> DataFrame:
    """One id per symbol, a preferred type first."""
    m = roles.table(spark, sf, "part").select(
        F.col("p_brand").alias("symbol"),
        F.col("p_partkey").alias("id"),
        F.col("p_type").endswith("BRASS").alias("coding"),
    )
    return first_by(m, ["symbol"], [~F.col("coding"), F.col("id")], ["id"])
