"""Record layouts and the fixed values they share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the assay: cell lines, days, the smallest group that may
# serve as a fold, and the stamp on written records.
CELL_LINES = ("HAP1", "HEK293FT", "K562", "MDA-MB-231", "THP1")
DAYS = (7, 14)
MIN_FOLD_RECORDS = 500
RECORD_VERSION = 1
BASES = ("A", "C", "G", "T")
GUIDE_LENGTH = 23
P_FLOOR = 1e-12
STRENGTH_CAP = 8.0
HIT_P = 0.05

SCREEN_RECORD = T.StructType(
    [
        T.StructField("guide_id", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("target_sequence", T.StringType()),
        T.StructField("cell_line", T.StringType()),
        T.StructField("day", T.DoubleType()),
        T.StructField("replicate", T.DoubleType()),
        T.StructField("fold_change", T.DoubleType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("strand", T.StringType()),
        T.StructField("closest_pc_gene", T.StringType()),
        T.StructField("distance_to_closest_pc_gene", T.DoubleType()),
    ]
)

GENE_RECORD = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("cell_line", T.StringType()),
        T.StructField("day", T.DoubleType()),
        T.StructField("rra_pvalue", T.DoubleType()),
        T.StructField("fold_change", T.DoubleType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("strand", T.StringType()),
        T.StructField("closest_pc_gene", T.StringType()),
        T.StructField("distance_to_closest_pc_gene", T.DoubleType()),
    ]
)

# Numbers arrive as 14 or 14.0, so they are read as double and narrowed here.
_NARROW = {
    "day": "int",
    "replicate": "int",
    "label": "int",
    "distance_to_closest_pc_gene": "bigint",
}
_TEXT_DEFAULT = ("chrom", "strand", "closest_pc_gene")


def typed(name: str) -> Column:
    """The column as the record type wants it, with its default for a missing field."""
    col = F.col(name)
    if name in _NARROW:
        return col.cast(_NARROW[name]).alias(name)
    if name in _TEXT_DEFAULT:
        return F.coalesce(col, F.lit("")).alias(name)
    return col
