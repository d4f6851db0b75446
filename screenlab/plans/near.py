"""Nearest-neighbour queries on the embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators import neighbours, resample, vector_index
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all
from screenlab.plans.sqltext import r

K = 15
_D = " + ".join(f"(a.vec[{i}]::DOUBLE - b.vec[{i}]) ** 2" for i in range(1, 65))
_NEAR = f"""
, d AS (SELECT a.id, b.id AS neighbour, round(sqrt({_D}), 9) AS distance FROM emb a JOIN emb b ON a.id <> b.id)
, near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INT) AS place FROM d)
  WHERE place <= {K})
"""


def _near(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    emb = roles.emb(spark, sf)
    return neighbours.knn(emb, emb, k)


@query("nearest_neighbours", _NEAR + "SELECT id, neighbour, distance, place FROM near", ("emb",))
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf)


@query(
    "label_purity",
    _NEAR
    + f"""
, p AS (SELECT near.id, a.label, avg(CAST(a.label = b.label AS INT)) AS purity FROM near JOIN emb a ON a.id = near.id
   JOIN emb b ON b.id = neighbour GROUP BY near.id, a.label)
SELECT label, {r('avg(purity)', 'mean')}, count(*) AS rows FROM p GROUP BY label""",
    ("emb",),
)
def label_purity(spark: SparkSession, sf: str) -> DataFrame:
    labels = roles.emb(spark, sf).select("id", "label")
    purity = neighbours.label_purity(_near(spark, sf), labels)
    return round_all(neighbours.purity_by_label(purity), ["mean"])


@query(
    "knn_probability",
    _NEAR
    + f"""SELECT near.id, {r('''coalesce(avg(CAST(b.label >= 5 AS INT)) FILTER (distance = 0),
   sum(CAST(b.label >= 5 AS INT) / distance) FILTER (distance > 0) / sum(1 / distance) FILTER (distance > 0))''', 'probability')}
FROM near JOIN emb b ON b.id = neighbour GROUP BY near.id""",
    ("emb",),
)
def knn_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Every row classified by its neighbours, itself left out."""
    labels = roles.emb(spark, sf).select("id", (F.col("label") >= 5).cast("int").alias("y"))
    return round_all(neighbours.knn_vote(_near(spark, sf), labels), ["probability"])


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The embeddings, every hundredth of them as a query, and what an index finds for these."""
    emb = roles.emb(spark, sf)
    asked = emb.where(F.col("id") % 100 == 0)
    index = vector_index.fit_index(emb, K)
    rows = vector_index.index_rows(index, emb)
    return emb, asked, vector_index.search_index(index, rows, emb, asked, K)


@query("indexed_neighbours")
def indexed_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Near rows of every hundredth one, by cells of short codes and exact comparison of the best."""
    return _indexed(spark, sf)[2]


@query(
    "indexed_neighbour_recall",
    f"""SELECT count(*) FILTER (id % 100 = 0) AS queries, count(*) FILTER (id % 100 = 0) * {K} AS neighbours,
TRUE AS reached, round(least({8 * K}, count(*)) / count(*), 9) AS compared FROM emb""",
    ("emb",),
)
def indexed_neighbour_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index finds nine tenths of what exact search does, and the share of rows it compares."""
    emb, asked, found = _indexed(spark, sf)
    seen = vector_index.recall(found, neighbours.knn(asked, emb, K))
    n = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
    return seen.select(
        asked.agg(F.count(F.lit(1)).alias("n")).scalar().alias("queries"),
        "neighbours",
        (F.col("recall") >= 0.9).alias("reached"),
        F.round(F.least(F.lit(8 * K), n) / n, 9).alias("compared"),
    )


def _binary(spark: SparkSession, sf: str) -> DataFrame:
    return roles.emb(spark, sf).select("id", "vec", (F.col("label") == 0).cast("int").alias("y"))


@query(
    "smote_balance",
    """, c AS (SELECT count(*) FILTER (label = 0) AS pos, count(*) FILTER (label <> 0) AS neg FROM emb)
SELECT ratio, CASE WHEN y = 1 THEN greatest(CAST(floor(ratio * neg) AS BIGINT), pos) ELSE neg END AS rows,
  CAST(y AS INT) AS y, CAST(CASE WHEN y = 1 THEN greatest(CAST(floor(ratio * neg) AS BIGINT) - pos, 0) ELSE 0 END AS BIGINT) AS made,
  CAST(0 AS BIGINT) AS off_segment
FROM c, (SELECT unnest([0.5e0, 1e0]) AS ratio), (SELECT unnest([0, 1]) AS y)""",
    ("emb",),
)
def smote_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Class sizes with synthetic positives, how many there are, and how many lie off their parents' segment."""
    rows = _binary(spark, sf)
    ends = rows.select("id", F.col("vec").alias("a")), rows.select(F.col("id").alias("neighbour"), F.col("vec").alias("b"))
    out = None
    for ratio in (0.5, 1.0):
        new = neighbours.synthetic(rows, ratio=ratio).join(ends[0], "id").join(ends[1], "neighbour")
        parts = F.arrays_zip("vec", "a", "b")
        # Each component at the same share of the way, in single precision of the data.
        apart = F.exists(parts, lambda x: F.abs(x["a"] + (x["b"] - x["a"]) * F.col("t") - x["vec"]) > 1e-6)
        off = (apart | (F.col("t") < 0) | (F.col("t") >= 1)).cast("long")
        made = new.select(F.lit(1).alias("y"), F.lit(1).cast("long").alias("made"), off.alias("off"))
        both = rows.select("y", F.lit(0).cast("long").alias("made"), F.lit(0).cast("long").alias("off")).unionByName(made)
        each = both.groupBy("y").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("made").alias("made"), F.sum("off").alias("off_segment")
        )
        each = each.select(F.lit(ratio).alias("ratio"), "y", "rows", "made", "off_segment")
        out = each if out is None else out.unionByName(each)
    return out


@query("smote_tomek_balance")
def smote_tomek_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Class sizes after synthetic positives were added and Tomek links taken out."""
    design = _binary(spark, sf).select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), "y")
    return resample.resample(design, "smote_tomek", "y", "id").groupBy("y").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "tomek_links",
    f"""
, d AS (SELECT a.id, b.id AS neighbour, round(sqrt({_D}), 9) AS distance FROM emb a JOIN emb b ON a.id <> b.id)
, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS k FROM d) WHERE k = 1)
SELECT x.id FROM one x JOIN one y ON x.neighbour = y.id AND y.neighbour = x.id
JOIN emb a ON a.id = x.id JOIN emb b ON b.id = x.neighbour WHERE (a.label = 0) <> (b.label = 0)""",
    ("emb",),
)
def tomek_links(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual nearest neighbours of opposite class."""
    return neighbours.tomek_links(_binary(spark, sf))
