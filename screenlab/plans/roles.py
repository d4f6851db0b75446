"""Role views: the driver's tables dressed as screen data, in Spark and in SQL.

Both texts define the same rows.  Fold changes are built from integer
hundredths, so sign and zero do not depend on the order of a float sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.sources.tables import dealt_out

# Letters onto bases for the text-derived sequences.
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_AS_BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"
# The six groups that stand in for cell lines.
CELLS = ("AF", "AO", "NF", "NO", "RF", "RO")
SAMPLES = ("click", "error", "purchase", "signup", "view")
# Postnatal stages in order of age.
POSTNATAL = (
    "newborn",
    "infant",
    "toddler",
    "school",
    "youngteenager",
    "teenager",
    "oldteenager",
    "youngadult",
    "youngmidage",
    "oldermidage",
    "senior",
)
GUIDE_STRIDE = 151
LOCUS_STRIDE = 400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_TABLE = bytes.maketrans((_LETTERS + "0123456789").encode(), (_AS_BASES + "N" * 10).encode())
_DROPPED = bytes(sorted(set(range(256)) - set((_LETTERS + "0123456789").encode())))


def _as_bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        dna = [None if t is None else t.translate(_TABLE, _DROPPED) for t in texts]
        yield pa.record_batch([batch.column(0), pa.array(dna, pa.binary()).cast(pa.string())], ["target", "seq"])


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    """Letters become bases, digits N; everything else is dropped."""
    texts = dealt_out(table(spark, sf, "documents").select("doc_id", "text"))
    kind = dict(texts.dtypes)["doc_id"]
    # No byte of a longer UTF-8 letter is that of a kept one, so bytes tell.
    return texts.mapInArrow(_as_bases, f"target {kind}, seq string")


def guides(spark: SparkSession, sf: str) -> DataFrame:
    """A 23-base guide every 151 bases of the whole sequence, odd ones from the other strand."""
    # Bytes are cut, as a cut in a text walks to its place from the start.
    tiles = seqs(spark, sf).select("target", F.col("seq").cast("binary").alias("seq")).where(F.length("seq") >= 23)
    cuts = F.expr(
        f"transform(sequence(0, cast((length(seq) - 23) div {GUIDE_STRIDE} as int)),"
        f" i -> struct(i, substring(seq, 1 + {GUIDE_STRIDE} * i, 23) as cut))"
    )
    flipped = F.reverse(F.translate("cut", "ACGT", "TGCA"))
    return (
        tiles.select("target", F.explode(cuts).alias("x"))
        .select("target", "x.i", F.col("x.cut").cast("string").alias("cut"))
        .select(
            (F.col("target") * 1000000 + F.col("i")).alias("guide_id"),
            "target",
            F.when(F.col("i") % 2 == 1, flipped).otherwise(F.col("cut")).alias("spacer"),
        )
    )


def screen(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("l_discount") * 100).cast("bigint") - 5
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("guide"),
        F.col("l_partkey").alias("target"),
        F.concat("l_returnflag", "l_linestatus").alias("cell"),
        F.when(F.col("l_linenumber") % 2 == 0, 7).otherwise(14).alias("day"),
        (F.col("l_quantity").cast("int") % 2 + 1).alias("rep"),
        cents.alias("fc100"),
        (cents / F.lit(100.0)).alias("fc"),
    )


def gene(spark: SparkSession, sf: str) -> DataFrame:
    per = (
        screen(spark, sf)
        .groupBy("target", "cell")
        .agg(F.sum("fc100").alias("s"), F.count(F.lit(1)).alias("c"))
    )
    code = F.ascii("cell") * 31 + F.ascii(F.substring("cell", 2, 1))
    target_part = (F.col("target") * 7919 % 1009) / F.lit(1009.0)
    cell_part = ((F.col("target") * 104729 + code * 6151) % 1013) / F.lit(1013.0)
    p = F.least(F.lit(1.0), F.lit(4.0) * (target_part * cell_part))
    fc = F.col("s") / (F.col("c") * F.lit(100.0))
    chroms = table(spark, sf, "part").select(
        F.col("p_partkey").alias("target"), F.col("p_size").cast("string").alias("chrom")
    )
    return (
        per.select("target", "cell", p.alias("p"), fc.alias("fc"))
        .withColumn("label", ((F.col("p") < 0.05) & (F.col("fc") < 0)).cast("int"))
        .join(chroms, "target")
    )


def exons(spark: SparkSession, sf: str) -> DataFrame:
    """Exons of a gene lie in its own stretch of the chromosome, half-open."""
    start = (
        F.expr("c_custkey div 25") * 2600
        + F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_shipdate", "l_quantity")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").alias("gene"),
            F.col("l_orderkey").alias("tx"),
            F.col("c_nationkey").cast("string").alias("chrom"),
            start.cast("bigint").alias("s"),
            (start + F.col("l_quantity").cast("bigint")).cast("bigint").alias("e"),
            F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        )
    )


def elements(spark: SparkSession, sf: str) -> DataFrame:
    start = (
        F.expr("c_custkey div 25") * 2600
        + F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    ).cast("bigint")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("element"),
            F.col("c_nationkey").cast("string").alias("chrom"),
            start.alias("s"),
            (start + 30).alias("e"),
            F.round("o_totalprice").alias("score"),
            (F.col("o_totalprice") / F.lit(1000.0)).alias("lod"),
        )
    )


def loci(spark: SparkSession, sf: str) -> DataFrame:
    """Two-transcript gene models over the text-derived contigs, 1-based closed."""
    at = F.explode(F.expr(f"sequence(0, cast(length(seq) div {LOCUS_STRIDE} as int))"))
    models = F.expr(
        "array(struct(1 as tx, 1 as a, 60 as b), struct(1 as tx, 121 as a, 200 as b),"
        " struct(2 as tx, 31 as a, 120 as b))"
    )
    base = F.col("i") * LOCUS_STRIDE
    return (
        seqs(spark, sf)
        .select(F.col("target").alias("contig"), F.length("seq").alias("len"), at.alias("i"))
        .select("*", F.explode(models).alias("m"))
        .select(
            (F.col("contig") * 10000 + F.col("i")).alias("gene"),
            (F.col("contig") * 100000 + F.col("i") * 10 + F.col("m.tx")).alias("tx"),
            F.col("contig").cast("string").alias("chrom"),
            (base + F.col("m.a")).cast("bigint").alias("s"),
            F.least(base + F.col("m.b"), F.col("len")).cast("bigint").alias("e"),
            F.when(F.col("i") % 2 == 0, "+").otherwise("-").alias("strand"),
        )
        .where(F.col("e") >= F.col("s"))
    )


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return seqs(spark, sf).select(F.col("target").cast("string").alias("chrom"), "seq")


def contig_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The contigs as lines of one FASTA file, 60 letters each, in blocks that records run over."""
    cut = F.transform(
        F.sequence(F.lit(0), F.expr("cast((length(_b) + 59) div 60 as int)")),
        lambda i: F.struct(i.alias("i"), F.when(i == 0, F.concat(F.lit(">"), "chrom")).otherwise(
            F.substring("_b", (i - 1) * 60 + 1, F.lit(60)).cast("string")).alias("value")),
    )
    rows = contigs(spark, sf).select("chrom", F.col("seq").cast("binary").alias("_b"))
    at = F.col("chrom").cast("bigint") * (1 << 24) + F.col("x.i")
    return rows.select("chrom", F.explode(cut).alias("x")).select(
        F.lit("contigs").alias("source"), F.shiftright(at, 6).alias("block"), at.alias("nth"), "x.value"
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("sample"))
        .agg((cents / (F.count(F.lit(1)) * F.lit(100.0))).alias("value"))
    )


def atlas(spark: SparkSession, sf: str) -> DataFrame:
    """(gene, organ, stage, value): the hour of an event stands in for the stage."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    later = F.get(F.array(*[F.lit(s) for s in POSTNATAL]), F.col("h") - 13)
    stage = F.when(F.col("h") < 13, F.concat(F.col("h") + 4, F.lit("wpc"))).otherwise(later)
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("gene"),
            F.col("event_type").alias("organ"),
            F.hour("ts").alias("h"),
        )
        .agg((cents / (F.count(F.lit(1)) * F.lit(100.0))).alias("value"))
        .select("gene", "organ", stage.alias("stage"), "value")
    )


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"
    )


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Three models' scores for every (target, cell), long."""
    scores = F.array(
        F.struct(F.lit("depletion").alias("model"), (-F.col("fc")).alias("score")),
        F.struct(
            F.lit("hash").alias("model"),
            ((F.col("target") * 7919 + F.ascii("cell") * 31) % 997 / F.lit(997.0)).alias("score"),
        ),
        F.struct(F.lit("pvalue").alias("model"), (F.lit(1.0) - F.col("p")).alias("score")),
    )
    return (
        gene(spark, sf)
        .select("target", "cell", "label", F.explode(scores).alias("x"))
        .select("x.model", "target", "cell", "x.score", "label")
    )


_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "seqs": (
        (),
        f"""SELECT doc_id AS target,
          translate(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'),
            '{_LETTERS}0123456789', '{_AS_BASES}NNNNNNNNNN') AS seq
        FROM documents""",
    ),
    "guides": (
        ("seqs",),
        f"""SELECT target * 1000000 + i AS guide_id, target,
          CASE WHEN i % 2 = 1 THEN reverse(translate(cut, 'ACGT', 'TGCA')) ELSE cut END AS spacer
        FROM (SELECT target, i, substring(seq, (1 + {GUIDE_STRIDE} * i)::BIGINT, 23) AS cut
              FROM (SELECT target, seq,
                      unnest(range(0, (length(seq) - 23) // {GUIDE_STRIDE} + 1)) AS i
                    FROM seqs WHERE length(seq) >= 23))""",
    ),
    "screen": (
        (),
        """SELECT l_orderkey * 10 + l_linenumber AS guide, l_partkey AS target,
          l_returnflag || l_linestatus AS cell,
          CASE WHEN l_linenumber % 2 = 0 THEN 7 ELSE 14 END AS day,
          CAST(l_quantity AS INT) % 2 + 1 AS rep,
          CAST(round(l_discount * 100) AS BIGINT) - 5 AS fc100,
          (CAST(round(l_discount * 100) AS BIGINT) - 5) / 100e0 AS fc
        FROM lineitem""",
    ),
    "gene": (
        ("screen",),
        """SELECT target, cell, p, fc, CAST(p < 0.05 AND fc < 0 AS INT) AS label,
          CAST(p_size AS VARCHAR) AS chrom
        FROM (SELECT target, cell,
                least(1e0, 4e0 * (((target * 7919 % 1009) / 1009e0)
                  * (((target * 104729
                       + (ascii(cell) * 31 + ascii(substring(cell, 2, 1))) * 6151) % 1013)
                     / 1013e0))) AS p,
                CAST(sum(fc100) AS BIGINT) / (count(*) * 100e0) AS fc
              FROM screen GROUP BY target, cell)
        JOIN part ON p_partkey = target""",
    ),
    "exons": (
        (),
        """SELECT o_custkey AS gene, l_orderkey AS tx, CAST(c_nationkey AS VARCHAR) AS chrom,
          (o_custkey // 25) * 2600 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s,
          (o_custkey // 25) * 2600 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))
            + CAST(l_quantity AS BIGINT) AS e,
          CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey""",
    ),
    "elements": (
        (),
        """SELECT o_orderkey AS element, CAST(c_nationkey AS VARCHAR) AS chrom,
          (o_custkey // 25) * 2600 + date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS s,
          (o_custkey // 25) * 2600 + date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))
            + 30 AS e,
          round(o_totalprice) AS score, o_totalprice / 1000e0 AS lod
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "loci": (
        ("seqs",),
        f"""SELECT gene, tx, chrom, s, e, strand FROM (
          SELECT contig * 10000 + i AS gene, contig * 100000 + i * 10 + m.tx AS tx,
            CAST(contig AS VARCHAR) AS chrom,
            CAST(i * {LOCUS_STRIDE} + m.a AS BIGINT) AS s,
            CAST(least(i * {LOCUS_STRIDE} + m.b, len) AS BIGINT) AS e,
            CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS strand
          FROM (SELECT target AS contig, length(seq) AS len,
                  unnest(range(0, length(seq) // {LOCUS_STRIDE} + 1)) AS i FROM seqs)
          CROSS JOIN (SELECT unnest([{{'tx': 1, 'a': 1, 'b': 60}}, {{'tx': 1, 'a': 121, 'b': 200}},
                                     {{'tx': 2, 'a': 31, 'b': 120}}]) AS m))
        WHERE e >= s""",
    ),
    "contigs": (("seqs",), "SELECT CAST(target AS VARCHAR) AS chrom, seq FROM seqs"),
    "panel": (
        (),
        """SELECT user_id AS gene, event_type AS sample,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100e0) AS value
        FROM events GROUP BY user_id, event_type""",
    ),
    "atlas": (
        (),
        f"""SELECT user_id AS gene, event_type AS organ,
          CASE WHEN h < 13 THEN CAST(h + 4 AS VARCHAR) || 'wpc'
               ELSE {list(POSTNATAL)}[h - 12] END AS stage,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100e0) AS value
        FROM (SELECT user_id, event_type, hour(ts) AS h, value FROM events)
        GROUP BY user_id, event_type, h""",
    ),
    "emb": ((), "SELECT vec_id AS id, embedding AS vec, label FROM embeddings"),
    "preds": (
        ("gene",),
        """SELECT 'depletion' AS model, target, cell, -fc AS score, label FROM gene
        UNION ALL
        SELECT 'hash', target, cell, (target * 7919 + ascii(cell) * 31) % 997 / 997e0, label FROM gene
        UNION ALL
        SELECT 'pvalue', target, cell, 1e0 - p, label FROM gene""",
    ),
}


def with_roles(roles: tuple[str, ...], body: str) -> str:
    """``body`` behind a WITH clause defining the roles (and what they need)."""
    order: list[str] = []

    def need(role: str) -> None:
        for r in _SQL[role][0]:
            need(r)
        if role not in order:
            order.append(role)

    for role in roles:
        need(role)
    body = body.strip()
    if not order:
        return f"WITH {body[1:]}" if body.startswith(",") else body
    ctes = ",\n".join(f"{r} AS ({_SQL[r][1]})" for r in order)
    return f"WITH {ctes}\n{body}"
