"""Staged spreadsheet pages.

A page is a frame with its row position in ``row`` and text columns ``c0``,
``c1``, ...; title rows may stand above the header.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators.ordered import first_by
from screenlab.operators.screen import hit

# Header texts of the published pages.
CHROM = "Chr"
STRAND = "Strand"
NEIGHBOUR = "Closest protein-coding gene symbol"
DISTANCE = "Distance to closest protein-coding gene"
LNC_GROUP = "long non-coding RNA"
SCREENED_SUFFIX = " RfxCas13d"
FOLD_CHANGE = r"(?i)[Dd]ay\s*(\d+).*?[Rr]ep(?:licate)?\s*(\d+).*?\(Fold-change\)"


def read_page(spark: SparkSession, path: str) -> DataFrame:
    """A page staged as parquet or as CSV whose first column is the row position."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, header=False)
    names = raw.columns
    return raw.select(
        F.col(names[0]).cast("bigint").alias("row"),
        *[F.col(n).alias(f"c{i}") for i, n in enumerate(names[1:])],
    )


def header_row(page: DataFrame, marker: str) -> DataFrame:
    """One row: where the first cell equals the marker first, else the top row."""
    found = F.min(F.when(F.trim("c0") == marker, F.col("row")))
    return page.agg(F.coalesce(found, F.min("row")).alias("row"))


def body(page: DataFrame, marker: str) -> DataFrame:
    """Rows below the header, columns named by it; only the header row is fetched."""
    top = page.join(header_row(page, marker), "row").first()
    texts = [c for c in page.columns if c != "row"]
    if top is None:
        return page.limit(0)
    names = {c: (top[c] or c).strip() for c in texts}
    return page.where(F.col("row") > top["row"]).select(
        "row", *[F.col(c).alias(names[c]) for c in texts]
    )


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(c: Column) -> Column:
    """Trimmed, with the word "nan" as empty."""
    trimmed = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(trimmed) == "nan", F.lit("")).otherwise(trimmed)


def load_targets(page: DataFrame) -> DataFrame:
    """guide_id -> (target, target_sequence); blank ids dropped, the last row of an id wins."""
    rows = body(page, "ID")
    names = [c for c in rows.columns if c != "row"]
    kept = rows.select(
        "row",
        F.trim(_q(names[0])).alias("guide_id"),
        _q(names[1]).alias("target"),
        _q(names[2]).alias("target_sequence"),
    ).where(F.coalesce("guide_id", F.lit("")) != "")
    return first_by(kept, ["guide_id"], [-F.col("row")], ["target", "target_sequence"])


def load_target_groups(page: DataFrame) -> DataFrame:
    """target -> group; empty when the page has fewer than four columns."""
    rows = body(page, "ID")
    names = [c for c in rows.columns if c != "row"]
    if len(names) < 4:
        empty = F.lit(None).cast("string")
        return rows.limit(0).select(empty.alias("target"), empty.alias("group"))
    kept = rows.select(
        "row", _text(_q(names[1])).alias("target"), F.trim(_q(names[3])).alias("group")
    ).where(F.col("target") != "")
    return first_by(kept, ["target"], [-F.col("row")], ["group"])


def load_annotations(page: DataFrame) -> DataFrame:
    """target -> chromosome, strand, neighbour, distance (NULL unless a number)."""
    rows = body(page, "lncRNA")
    names = [c for c in rows.columns if c != "row"]
    have = set(names)

    def col(name: str) -> Column:
        return _text(_q(name)) if name in have else F.lit("")

    distance = col(DISTANCE).try_cast("double").try_cast("bigint")
    kept = rows.select(
        "row",
        _text(_q(names[0])).alias("target"),
        col(CHROM).alias("chrom"),
        col(STRAND).alias("strand"),
        col(NEIGHBOUR).alias("closest_pc_gene"),
        distance.alias("distance_to_closest_pc_gene"),
    ).where(F.col("target") != "")
    return first_by(
        kept,
        ["target"],
        [-F.col("row")],
        ["chrom", "strand", "closest_pc_gene", "distance_to_closest_pc_gene"],
    )


def decode_header(header: Column) -> tuple[Column, Column]:
    """(day, replicate) of a fold-change column's header."""
    return (
        F.regexp_extract(header, FOLD_CHANGE, 1).try_cast("int"),
        F.regexp_extract(header, FOLD_CHANGE, 2).try_cast("int"),
    )


def _annotate(df: DataFrame, annotations: DataFrame | None) -> DataFrame:
    empty = F.lit("")
    if annotations is None:
        return df.select(
            "*",
            empty.alias("chrom"),
            empty.alias("strand"),
            empty.alias("closest_pc_gene"),
            F.lit(None).cast("bigint").alias("distance_to_closest_pc_gene"),
        )
    return df.join(annotations, "target", "left").select(
        *df.columns,
        *[F.coalesce(c, empty).alias(c) for c in ("chrom", "strand", "closest_pc_gene")],
        "distance_to_closest_pc_gene",
    )


def load_screen(
    pages: Mapping[str, DataFrame], targets: DataFrame, annotations: DataFrame | None = None
) -> DataFrame:
    """Guide-level records from one page per cell line, wide to long."""
    import re

    parts = []
    for cell, page in pages.items():
        rows = body(page, "ID")
        names = [c for c in rows.columns if c != "row"]
        measured = [c for c in names[1:] if re.search(FOLD_CHANGE, c)]
        long = rows.select(_text(_q(names[0])).alias("guide_id"), *[_q(c) for c in measured]).unpivot(
            ["guide_id"], [f"`{c}`" for c in measured], "header", "text"
        )
        day, replicate = decode_header(F.col("header"))
        parts.append(
            long.where((F.col("guide_id") != "") & F.col("text").isNotNull()).select(
                "guide_id",
                F.lit(cell).alias("cell_line"),
                day.alias("day"),
                replicate.alias("replicate"),
                F.col("text").try_cast("double").alias("fold_change"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    found = out.join(targets, "guide_id", "left").select(
        *out.columns,
        F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce("target_sequence", F.lit("")).alias("target_sequence"),
    )
    return _annotate(found, annotations)


def load_rra(
    pages: Mapping[str, DataFrame],
    day: int,
    groups: DataFrame,
    annotations: DataFrame | None = None,
) -> DataFrame:
    """Gene-level records of one day: lncRNA targets with both values, labelled."""
    p_name, fc_name = f"Day {day} - P value", f"Day {day} - Fold-change (log2)"
    wanted = groups.where(F.col("group") == LNC_GROUP).select("target")
    parts = []
    for cell, page in pages.items():
        rows = body(page, "Gene")
        if p_name not in rows.columns or fc_name not in rows.columns:
            continue
        parts.append(
            rows.select(
                _text(_q("Gene")).alias("target"),
                F.lit(cell).alias("cell_line"),
                F.lit(day).alias("day"),
                _q(p_name).try_cast("double").alias("rra_pvalue"),
                _q(fc_name).try_cast("double").alias("fold_change"),
            )
        )
    if not parts:
        raise ValueError(f"no page has day {day}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    both = out.where((F.col("target") != "")).dropna(subset=["rra_pvalue", "fold_change"])
    kept = both.join(wanted, "target", "left_semi")
    labelled = kept.withColumn("label", hit("rra_pvalue", "fold_change"))
    return _annotate(labelled, annotations)


def expression_panel(df: DataFrame, gene: str, cells: list[str]) -> DataFrame:
    """Wide expression page as (gene, sample, value): the screened population's
    column where there is one, else the parental line's; not a number reads as 0."""
    picked = []
    for cell in cells:
        for name in (cell + SCREENED_SUFFIX, cell):
            if name in df.columns:
                value = F.coalesce(_q(name).try_cast("double"), F.lit(0.0))
                picked.append(F.struct(F.lit(cell).alias("sample"), value.alias("value")))
                break
    return df.select(F.col(gene).alias("gene"), F.explode(F.array(*picked)).alias("x")).select(
        "gene", "x.sample", "x.value"
    )


def coalesced_panel(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two long panels, the first page's value winning, as log1p with missing as 0."""
    a = first.select("gene", "sample", F.col("value").alias("_a"))
    b = second.select("gene", "sample", F.col("value").alias("_b"))
    return a.join(b, ["gene", "sample"], "full").select(
        "gene", "sample", F.log1p(F.coalesce("_a", "_b", F.lit(0.0))).alias("value")
    )


def wide_matrix(df: DataFrame, key: str, models: list[str]) -> DataFrame:
    """A few rows of a very wide matrix, long.  Headers lose a trailing " (123)";
    the first column of a symbol wins."""
    import re

    seen: dict[str, str] = {}
    for c in df.columns:
        if c != key:
            seen.setdefault(re.sub(r"\s+\(\d+\)$", "", c), c)
    rows = df.where(F.col(key).isin(*models))
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("gene"), _q(c).try_cast("double").alias("value"))
            for s, c in seen.items()
        ]
    )
    return rows.select(F.col(key).alias("sample"), F.explode(cells).alias("x")).select(
        "x.gene", "sample", "x.value"
    )


def restricted_matrix(df: DataFrame, gene: str, wanted: DataFrame) -> DataFrame:
    """A bulk matrix cut to the wanted genes before anything else is done with it."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias(gene)), gene, "left_semi")


def coordinates(df: DataFrame, prefix: str, dims: int | None = None) -> DataFrame:
    """(cell, vec) from columns ``prefix``1..n in numeric order."""
    cols = sorted(
        (c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()),
        key=lambda c: int(c[len(prefix) :]),
    )[:dims]
    return df.select(
        F.col("cell_line").alias("cell"), F.array(*[F.col(c).cast("double") for c in cols]).alias("vec")
    )
