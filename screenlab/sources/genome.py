"""Text formats of genome annotation: GTF, FASTA and conserved elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return gtf_fields(spark.read.text(path))


def _attribute(name: str) -> Column:
    return F.regexp_extract("attributes", rf'{name}\s+"?([^";]+)"?', 1)


def gtf_fields(lines: DataFrame) -> DataFrame:
    """Feature lines of a GTF, comments and short lines skipped; 1-based closed positions."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f"))
    rows = rows.where(F.size("f") >= 9).select(
        F.get("f", F.lit(0)).alias("chrom"),
        F.get("f", F.lit(2)).alias("feature"),
        F.get("f", F.lit(3)).try_cast("bigint").alias("s"),
        F.get("f", F.lit(4)).try_cast("bigint").alias("e"),
        F.get("f", F.lit(6)).alias("strand"),
        F.get("f", F.lit(8)).alias("attributes"),
    )
    return rows.select(
        "*",
        _attribute("gene_id").alias("gene"),
        _attribute("transcript_id").alias("tx"),
        _attribute("gene_name").alias("gene_name"),
        _attribute("gene_type").alias("gene_type"),
    )


def exons(fields: DataFrame) -> DataFrame:
    return fields.where((F.col("feature") == "exon") & (F.col("gene") != "")).select(
        "gene", "tx", "chrom", "s", "e", "strand"
    )


def gene_records(fields: DataFrame) -> DataFrame:
    """One row per gene line with an id and a symbol."""
    genes = fields.where(
        (F.col("feature") == "gene") & (F.col("gene") != "") & (F.col("gene_name") != "")
    )
    return genes.select(
        F.col("gene").alias("gene_id"),
        F.substring_index("gene", ".", 1).alias("gene_id_base"),
        "gene_name",
        "gene_type",
        "chrom",
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA split at each ">" that begins a line: one row per record, however long."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def fasta_records(chunks: DataFrame) -> DataFrame:
    """(name, seq) from record texts: first line is the header, the rest is joined.

    A record may keep the ">" of its first line, as the first of a file does.
    """
    chunks = chunks.withColumn("value", F.regexp_replace("value", r"^\s*>", ""))
    header = F.substring_index("value", "\n", 1)
    rest = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return (
        chunks.where(F.trim("value") != "")
        .select(
            F.element_at(F.split(F.trim(header), r"\s+"), 1).alias("name"),
            F.regexp_replace(rest, r"\s", "").alias("seq"),
        )
        .where(F.col("seq") != "")
    )


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, nth, value): the lines of FASTA files, and their order in a file.

    Lines of one block of a file are numbered in order; blocks by their first byte.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        "value",
    )


def placed_lines(lines: DataFrame) -> DataFrame:
    """(chrom, at, letters): every sequence line with its record's name and its place there.

    Places are sums of lengths: inside a block of lines, and from block to block by
    one summary row a block. A record is never put together. Lines before the first
    header of a file belong to none and go; a record of no letters has no row.
    """
    head = F.col("value").startswith(">")
    name = F.element_at(F.split(F.trim(F.substring("value", 2, 1 << 20)), r"\s+"), 1)
    letters = F.when(head, F.lit("")).otherwise(F.regexp_replace("value", r"\s", ""))
    rows = lines.select(
        "source", "block", "nth", F.when(head, name).alias("name"), letters.cast("binary").alias("letters")
    )
    inside = Window.partitionBy("source", "block").orderBy("nth")
    rows = rows.withColumn("part", F.count("name").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    of = Window.partitionBy("source", "block", "part")
    size = F.length("letters").cast("bigint")
    so_far = F.sum(size).over(of.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(
        "source", "block", "part", "letters", F.max("name").over(of).alias("name"), F.coalesce(so_far, F.lit(0)).alias("at")
    )
    parts = rows.groupBy("source", "block", "part").agg(F.max("name").alias("name"), F.sum(size).alias("size"))
    last = F.max_by(F.struct("name", "size"), "part").alias("x")
    blocks = parts.groupBy("source", "block").agg(last, F.max("part").alias("heads"))
    # One row a block: the record that goes on into the next block, and how far it has come.
    order = Window.partitionBy("source").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select("source", "block", "x.*", F.count_if(F.col("heads") > 0).over(upto).alias("record"))
    record = Window.partitionBy("source", "record")
    blocks = blocks.select(
        "source",
        "block",
        F.max("name").over(record).alias("name"),
        F.sum("size").over(record.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)).alias("come"),
    )
    carried = blocks.select(
        "source", "block", F.lag("name").over(order).alias("_name"), F.lag("come").over(order).alias("_come")
    )
    first = F.col("part") == 0
    placed = rows.join(carried, ["source", "block"]).select(
        F.when(first, F.col("_name")).otherwise(F.col("name")).alias("chrom"),
        (F.col("at") + F.when(first, F.coalesce("_come", F.lit(0))).otherwise(F.lit(0))).alias("at"),
        "letters",
    )
    return placed.where(F.col("chrom").isNotNull() & (F.length("letters") > 0))


def conserved_elements(lines: DataFrame) -> DataFrame:
    """chrom, start, end, name ("lod=<n>"), score, tab-separated; no lod reads as 0."""
    f = F.split("value", "\t")

    def at(i: int) -> Column:
        return F.get(f, F.lit(i))

    lod = F.substring_index(at(3), "=", -1).try_cast("double")
    return lines.select(
        at(0).alias("chrom"),
        at(1).try_cast("bigint").alias("s"),
        at(2).try_cast("bigint").alias("e"),
        F.coalesce(lod, F.lit(0.0)).alias("lod"),
        at(4).try_cast("double").alias("score"),
    ).where(F.col("s").isNotNull())
