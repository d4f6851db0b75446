"""Fold, resampling, weighting and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.functions import maths as fm
from screenlab.operators import folds, resample
from screenlab.operators import kmers as ko
from screenlab.operators.ordered import quantiles
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all, rounded
from screenlab.plans.sqltext import r

CELLS = roles.CELLS
MINIMUM = 230


def _order(seed: int = 7) -> Column:
    """A shuffled key, unique per (target, cell), that SQL can compute too."""
    code = F.ascii("cell") * 31 + F.ascii(F.substring("cell", 2, 1))
    mixed = (F.col("target") * 7919 + code * 131 + seed) % 104729
    return mixed * F.lit(10**12) + F.col("target") * F.lit(10**4) + code


_CODE = "(ascii(cell) * 31 + ascii(substring(cell, 2, 1)))"
_ORDER = (
    f"((target * 7919 + {_CODE} * 131 + 7) % 104729) * 1000000000000 + target * 10000 + {_CODE}"
)


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return roles.gene(spark, sf).select("target", "cell", "label", "chrom", _order().alias("k"))


@query(
    "split_by_chromosome",
    """SELECT target, cell, CASE WHEN chrom IN ('1', '7') THEN 'test' ELSE 'train' END AS part FROM gene""",
    ("gene",),
)
def split_by_chromosome(spark: SparkSession, sf: str) -> DataFrame:
    train, test = folds.split_by(roles.gene(spark, sf), "chrom", ["1", "7"])
    return train.select("target", "cell", F.lit("train").alias("part")).unionByName(
        test.select("target", "cell", F.lit("test").alias("part"))
    )


@query(
    "split_by_cell",
    "SELECT chrom, CASE WHEN cell = 'RF' THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM gene GROUP BY ALL",
    ("gene",),
)
def split_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    train, test = folds.split_by(roles.gene(spark, sf), "cell", ["RF"])
    each = train.select("chrom", F.lit("train").alias("part")).unionByName(
        test.select("chrom", F.lit("test").alias("part"))
    )
    return each.groupBy("chrom", "part").agg(F.count(F.lit(1)).alias("n"))


_FOLDS = f"""
, f AS (SELECT chrom AS fold, count(*) AS n FROM gene GROUP BY chrom HAVING count(*) >= {MINIMUM})
, nf AS (SELECT fold, n, coalesce(lead(fold) OVER (ORDER BY length(fold), fold),
    first(fold) OVER (ORDER BY length(fold), fold)) AS next_fold FROM f)
"""



@query("chromosome_folds", _FOLDS + "SELECT fold, n, next_fold FROM nf", ("gene",))
def chromosome_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folds.group_folds(roles.gene(spark, sf), "chrom", MINIMUM)


@query(
    "fold_role_sizes",
    _FOLDS
    + """
SELECT fold, role, CAST(CASE role WHEN 'validation' THEN v WHEN 'early_stop' THEN e ELSE t - v - e END AS BIGINT) AS rows
FROM (SELECT fold, (SELECT count(*) FROM gene WHERE chrom = fold) AS v,
   (SELECT count(*) FROM gene WHERE chrom = next_fold) AS e, (SELECT count(*) FROM gene) AS t FROM nf)
CROSS JOIN (SELECT unnest(['validation', 'early_stop', 'train']) AS role)""",
    ("gene",),
)
def fold_role_sizes(spark: SparkSession, sf: str) -> DataFrame:
    gene = roles.gene(spark, sf)
    total = gene.agg(F.count(F.lit(1)).alias("n")).scalar()
    return folds.fold_sizes(folds.group_folds(gene, "chrom", MINIMUM), total)


@query(
    "leave_one_cell_out_roles",
    """SELECT target, cell, CASE WHEN cell = 'RF' THEN 'validation' WHEN cell = 'RO' THEN 'early_stop'
  ELSE 'train' END AS role FROM gene""",
    ("gene",),
)
def leave_one_cell_out_roles(spark: SparkSession, sf: str) -> DataFrame:
    role = folds.fold_role("cell", "RF", "RO")
    return roles.gene(spark, sf).select("target", "cell", role.alias("role"))


@query(
    "stratified_folds",
    f"""SELECT target, cell, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) - 1) % 5 AS INT) AS fold
FROM gene""",
    ("gene",),
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    out = folds.stratified_folds(_keyed(spark, sf), "label", "k", 5)
    return out.select("target", "cell", "label", "fold")


@query(
    "stratified_carve_out",
    f"""SELECT target, cell, (row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) - 1) % 10 = 0 AS held
FROM gene""",
    ("gene",),
)
def stratified_carve_out(spark: SparkSession, sf: str) -> DataFrame:
    return folds.carve_out(_keyed(spark, sf), "label", "k").select("target", "cell", "held")


@query(
    "stratified_group_folds",
    """
, s AS (SELECT chrom, pos, n, row_number() OVER (ORDER BY abs(n - 2 * pos) DESC, chrom) AS i
  FROM (SELECT chrom, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM gene GROUP BY chrom))
SELECT chrom, pos, n, fold FROM (
  WITH RECURSIVE tot AS (SELECT sum(pos)::DOUBLE AS p, sum(n - pos)::DOUBLE AS q FROM s)
  , walk AS (
    SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS a, [0, 0, 0, 0, 0]::BIGINT[] AS b, -1::INT AS fold
    UNION ALL
    SELECT i, list_transform(range(0, 5), lambda j: a[j + 1] + CASE WHEN j = f THEN pos ELSE 0 END),
      list_transform(range(0, 5), lambda j: b[j + 1] + CASE WHEN j = f THEN n - pos ELSE 0 END), f::INT
    FROM (
      SELECT s.i, a, b, pos, n, list_sort(list_transform(range(0, 5), lambda j: {
        'e': round((list_aggregate(list_transform(range(0, 5), lambda x: (a[x + 1] + CASE WHEN x = j THEN pos ELSE 0 END) / p), 'stddev_pop')
          + list_aggregate(list_transform(range(0, 5), lambda x: (b[x + 1] + CASE WHEN x = j THEN n - pos ELSE 0 END) / q), 'stddev_pop')) / 2, 9),
        'h': a[j + 1] + b[j + 1], 'j': j}))[1].j AS f
      FROM walk JOIN s ON s.i = walk.i + 1, tot
    )
  )
  SELECT s.*, walk.fold FROM walk JOIN s USING (i)
)""",
    ("gene",),
)
def stratified_group_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Chromosomes dealt one by one to the fold where they even out the classes."""
    return folds.stratified_group_folds(roles.gene(spark, sf), "chrom", "label", 5)


SMALL = 20
_SMALL_FOLDS = f"""
, f AS (SELECT chrom AS fold, count(*) AS n FROM gene GROUP BY chrom HAVING count(*) >= {SMALL})
, nf AS (SELECT fold, n, coalesce(lead(fold) OVER (ORDER BY length(fold), fold),
    first(fold) OVER (ORDER BY length(fold), fold)) AS next_fold FROM f)
, role AS (SELECT target, cell, chrom, label, fold,
    CASE WHEN chrom = fold THEN 'validation' WHEN chrom = next_fold THEN 'early_stop' ELSE 'train' END AS role
  FROM gene, nf)
"""


@query("fold_roles", _SMALL_FOLDS + "SELECT target, cell, fold, role FROM role", ("gene",))
def fold_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's role in every fold."""
    gene = roles.gene(spark, sf)
    out = folds.fold_roles(gene, "chrom", folds.group_folds(gene, "chrom", SMALL))
    return out.select("target", "cell", "fold", "role")


@query(
    "fold_vocabularies",
    """
, w AS (SELECT target, seq, unnest(range(1, length(seq) - 2)) AS i FROM seqs WHERE length(seq) >= 4)
, km AS (SELECT DISTINCT target, substring(seq, i, 4) AS kmer FROM w)
, pk AS (SELECT DISTINCT chrom, kmer FROM gene JOIN km USING (target) WHERE NOT contains(kmer, 'N'))
"""
    + _SMALL_FOLDS
    + """
, vocab AS (SELECT DISTINCT fold, kmer FROM nf JOIN pk ON chrom IS DISTINCT FROM fold AND chrom IS DISTINCT FROM next_fold)
, held AS (SELECT fold, 'validation' AS role, kmer FROM nf JOIN pk ON chrom = fold
  UNION ALL SELECT fold, 'early_stop', kmer FROM nf JOIN pk ON chrom = next_fold WHERE next_fold <> fold
  UNION ALL SELECT fold, 'train', kmer FROM vocab)
, k AS (SELECT fold, role, count(*) AS kmers, count(*) FILTER (vocab.kmer IS NULL) AS unseen
  FROM held LEFT JOIN vocab USING (fold, kmer) GROUP BY fold, role)
SELECT fold, role, n AS rows, pos AS positives, coalesce(kmers, 0) AS kmers, coalesce(unseen, 0) AS unseen
FROM (SELECT fold, role, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM role GROUP BY fold, role) LEFT JOIN k USING (fold, role)""",
    ("gene", "seqs"),
)
def fold_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """Per fold and role: rows, positives, k-mers of its sequences, and those outside the fold's vocabulary."""
    gene = roles.gene(spark, sf)
    table = folds.group_folds(gene, "chrom", SMALL)
    sizes = folds.fold_roles(gene, "chrom", table).groupBy("fold", "role")
    sizes = sizes.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("bigint")).alias("positives"))
    used = gene.select("target", "chrom").distinct()
    counted = ko.kmer_counts(roles.seqs(spark, sf), ["target"], "seq", 4, spread=True)
    seen = used.join(counted.select("target", "kmer"), "target").select("chrom", "kmer").distinct()
    vocab = folds.fold_vocabulary(seen, "chrom", table)
    role = F.lit("validation").alias("role")
    held = table.select("fold", F.col("fold").alias("chrom"), role)
    early = table.where("fold <> next_fold").select("fold", F.col("next_fold").alias("chrom"), F.lit("early_stop").alias("role"))
    others = held.unionByName(early).join(seen, "chrom").select("fold", "role", "kmer")
    kmers = others.unionByName(vocab.select("fold", F.lit("train").alias("role"), "kmer"))
    known = vocab.select("fold", "kmer", F.lit(1).alias("known"))
    count = kmers.join(known, ["fold", "kmer"], "left").groupBy("fold", "role")
    count = count.agg(F.count(F.lit(1)).alias("kmers"), F.count_if(F.col("known").isNull()).alias("unseen"))
    zero = F.lit(0).cast("bigint")
    return sizes.join(count, ["fold", "role"], "left").select(
        "fold", "role", "rows", "positives", F.coalesce("kmers", zero).alias("kmers"), F.coalesce("unseen", zero).alias("unseen")
    )


@query(
    "holdout_publication",
    """SELECT 'train' AS part, target, cell, label FROM gene WHERE cell NOT IN ('NF', 'NO')
UNION ALL SELECT 'features', target, cell, NULL FROM gene WHERE cell = 'NF'
UNION ALL SELECT 'labels', target, cell, label FROM gene WHERE cell = 'NF'""",
    ("gene",),
)
def holdout_publication(spark: SparkSession, sf: str) -> DataFrame:
    parts = folds.publish_holdout(roles.gene(spark, sf), "cell", "NF", ["NO"])
    if folds.leaked_columns(parts["features"]):
        raise AssertionError("published features hold answers")
    none = F.lit(None).cast("int").alias("label")
    cols = ["part", "target", "cell", "label"]
    return (
        parts["train"]
        .select(F.lit("train").alias("part"), *cols[1:])
        .unionByName(parts["features"].select(F.lit("features").alias("part"), "target", "cell", none))
        .unionByName(parts["labels"].select(F.lit("labels").alias("part"), *cols[1:]))
    )


@query(
    "random_under_sample",
    f"""
, k AS (SELECT target, cell, label, row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) AS rn FROM gene)
SELECT target, cell, label FROM k
WHERE label = 1 OR rn <= floor((SELECT count(*) FROM gene WHERE label = 1) / 0.5e0)""",
    ("gene",),
)
def random_under_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.resample(_keyed(spark, sf), "random_under", "label", "k", 0.5)
    return out.select("target", "cell", "label")


@query(
    "random_over_sample",
    f"""
, c AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM gene)
, k AS (SELECT target, cell, label, row_number() OVER (PARTITION BY label ORDER BY {_ORDER}) AS rn FROM gene)
, m AS (SELECT target, cell, label, CASE WHEN label = 1
    THEN neg // pos + CASE WHEN rn <= neg - (neg // pos) * pos THEN 1 ELSE 0 END ELSE 1 END AS copies FROM k, c)
SELECT target, cell, label FROM (SELECT *, unnest(range(0, copies)) FROM m)""",
    ("gene",),
)
def random_over_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.resample(_keyed(spark, sf), "random_over", "label", "k")
    return out.select("target", "cell", "label")


@query(
    "balanced_bagging_samples",
    """, c AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM gene)
SELECT CAST(unnest(range(0, 5)) AS INT) AS estimator, pos + least(pos, neg) AS n, pos, pos + least(pos, neg) AS distinct_rows FROM c""",
    ("gene",),
)
def balanced_bagging_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and positives drawn per estimator; sizes are exact, the draw is hash-ordered."""
    out = resample.bagging_samples(_keyed(spark, sf), "label", "k", 5, 1.0)
    return out.groupBy("estimator").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("pos"),
        F.count_distinct("k").alias("distinct_rows"),
    )


_COORDS = """
, cc AS (SELECT cell, round(avg(fc) * 100, 6) AS x, round(avg(p) * 10, 6) AS y, avg(label) AS rate,
   substring(cell, 2, 1) AS lineage FROM gene GROUP BY cell)
"""


def _coords(spark: SparkSession, sf: str) -> DataFrame:
    return roles.gene(spark, sf).groupBy("cell").agg(
        F.array(F.round(F.avg("fc") * 100, 6), F.round(F.avg("p") * 10, 6)).alias("vec"),
        F.avg("label").alias("rate"),
        F.substring(F.first("cell"), 2, 1).alias("lineage"),
    )


@query(
    "cell_weights",
    _COORDS
    + f"""
, d AS (SELECT a.cell, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.rate, a.lineage = b.lineage AS same
   FROM cc a, cc b WHERE a.cell <> 'RF' AND b.cell = 'RF')
, raw AS (SELECT 'uniform' AS scheme, cell, 1e0 AS raw FROM d
  UNION ALL SELECT 'coordinates', cell, exp(-d / (SELECT avg(d) FROM d)) FROM d
  UNION ALL SELECT 'lineage', cell, CASE WHEN same THEN 3e0 ELSE 1e0 END FROM d
  UNION ALL SELECT 'posrate', cell, 1 / greatest(rate, 1e-6) FROM d)
SELECT scheme, cell, {r('raw / sum(raw) OVER (PARTITION BY scheme) * count(*) OVER (PARTITION BY scheme)', 'weight')} FROM raw""",
    ("gene",),
)
def cell_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Row weights per source cell under each scheme, mean 1."""
    cells = _coords(spark, sf)
    out = None
    for name, scheme in resample.SCHEMES.items():
        args = (3.0,) if name == "lineage" else ()
        part = scheme(cells, "RF", *args).select(F.lit(name).alias("scheme"), "cell", "weight")
        out = part if out is None else out.unionByName(part)
    return round_all(out, ["weight"])


@query(
    "control_weight",
    f"""
, w AS (SELECT label, CASE WHEN cell = 'NO' THEN 2.5e0 ELSE 1e0 END AS w FROM gene)
, e AS (SELECT sum(w * label) / sum(w) AS eff, avg(label) AS base FROM w)
SELECT {r('eff', 'eff')}, {r('base', 'base')}, {r('(eff / (1 - eff)) / (base / (1 - base))', 'ratio')} FROM e""",
    ("gene",),
)
def control_weight(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.control_weight(roles.gene(spark, sf), F.col("cell") == "NO", 2.5, "label")
    return round_all(out, ["eff", "base", "ratio"])


@query(
    "class_weights",
    f"""
, q AS (SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) AS q FROM gene)
SELECT scheme, {r("CASE scheme WHEN 'one' THEN 1e0 WHEN 'sqrt' THEN sqrt(q) ELSE q END * 1.5e0", 'weight')}
FROM q CROSS JOIN (SELECT unnest(['one', 'sqrt', 'balanced']) AS scheme)""",
    ("gene",),
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(resample.class_weights(roles.gene(spark, sf), "label", 1.5), ["weight"])


# ---- scalar functions --------------------------------------------------------------


@query(
    "safe_log_and_ratio",
    f"""SELECT event_id, {r('ln(1 + greatest(coalesce(value - 20, 0), 0))', 'logged')},
  {r('value / greatest(event_id % 3, 1e-6)', 'ratio', 3)}, {r('1 / (1 + exp(-(value - 20) / 10))', 'squashed')}
FROM events""",
)
def safe_log_and_ratio(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return roles.table(spark, sf, "events").select(
        "event_id",
        rounded(fm.safe_log1p(v - 20)).alias("logged"),
        rounded(fm.safe_ratio(v, (F.col("event_id") % 3).cast("double")), 3).alias("ratio"),
        rounded(fm.sigmoid((v - 20) / 10)).alias("squashed"),
    )


@query(
    "symmetric_clip",
    f"""
, l AS (SELECT greatest(0.01e0, quantile_cont(abs(fc), 0.95)) AS lim FROM gene)
SELECT target, cell, {r('greatest(least(fc, lim), -lim)', 'clipped')}, {r('lim', 'lim')} FROM gene, l""",
    ("gene",),
)
def symmetric_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Fold changes held within the 0.95 quantile of their size."""
    gene = roles.gene(spark, sf).select("target", "cell", "fc")
    sizes = gene.select(F.abs("fc").alias("size"))
    limit = quantiles(sizes, [], "size", {"q": 0.95}).select(
        F.greatest(F.lit(0.01), "q").alias("q")
    )
    rows = gene.withColumn("lim", limit.scalar())
    clipped = fm.clip(F.col("fc"), F.col("lim")).alias("clipped")
    return round_all(rows.select("target", "cell", clipped, "lim"), ["clipped", "lim"])


@query(
    "category_one_hot",
    f"""SELECT p_partkey, {', '.join(f"CAST(p_size % 7 = {i} AS INT) * 1e0 AS size_{i}" for i in range(5))},
   CASE WHEN p_size % 11 = 0 THEN 0e0 ELSE p_size * 1e0 END AS distance,
   CAST(p_size % 11 = 0 AS INT) * 1e0 AS distance_missing FROM part""",
)
def category_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Five known categories out of seven, and a filled column with its missing flag."""
    part = roles.table(spark, sf, "part")
    kind = (F.col("p_size") % 7).cast("string")
    distance = F.when(F.col("p_size") % 11 != 0, F.col("p_size"))
    return part.select(
        "p_partkey",
        *fm.one_hot(kind, [str(i) for i in range(5)], "size_"),
        *fm.filled(distance, "distance"),
    )


@query(
    "list_cell_indicators",
    """
, t AS (SELECT p_partkey, [trim(x) FOR x IN string_split(replace(p_name, ' ', ', '), ',') IF trim(x) <> ''] AS items FROM part)
SELECT p_partkey, CAST(list_contains(items, 'part') AS INT) * 1e0 AS has_part,
  CAST(list_contains(items, 'Part#000000001') AS INT) * 1e0 AS has_first,
  CAST(len(list_distinct([x FOR x IN items IF x NOT IN ('part', 'Part#000000001')])) AS INT) AS unknown FROM t""",
)
def list_cell_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """A comma-separated cell as indicators, with the number of items not on the list."""
    cell = F.regexp_replace("p_name", " ", ", ")
    known = ["part", "Part#000000001"]
    a, b = fm.multi_hot(cell, known, "")
    return roles.table(spark, sf, "part").select(
        "p_partkey",
        a.alias("has_part"),
        b.alias("has_first"),
        F.size(fm.unknown_items(cell, known)).alias("unknown"),
    )


@query(
    "two_set_softmax",
    f"""
, m AS (SELECT id, greatest(vec[1], vec[2], vec[3], vec[4]) AS t, vec FROM emb)
, e AS (SELECT id, exp(vec[1]::DOUBLE - t) + exp(vec[2]::DOUBLE - t) AS a, exp(vec[3]::DOUBLE - t) + exp(vec[4]::DOUBLE - t) AS b FROM m)
SELECT id, {r('a / (a + b)', 'p_yes')} FROM e""",
    ("emb",),
)
def two_set_softmax(spark: SparkSession, sf: str) -> DataFrame:
    p = fm.two_set_probability(F.col("vec"), [0, 1], [2, 3])
    return roles.emb(spark, sf).select("id", rounded(p).alias("p_yes"))


_STAGE = f"""CASE WHEN stage LIKE '%wpc' THEN CAST(replace(stage, 'wpc', '') AS DOUBLE)
   ELSE list_position({list(roles.POSTNATAL)}, stage) + 99e0 END"""


@query(
    "stage_axis",
    f"""
, s AS (SELECT gene, organ, stage, {_STAGE} AS rk FROM atlas)
SELECT gene, organ, stage, {r('(rk - (SELECT min(rk) FROM s)) / ((SELECT max(rk) FROM s) - (SELECT min(rk) FROM s))', 'axis')} FROM s""",
    ("atlas",),
)
def stage_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Developmental stage on a 0..1 axis."""
    rk = fm.stage_rank(F.col("stage"), roles.POSTNATAL)
    rows = roles.atlas(spark, sf).select("gene", "organ", "stage", rk.alias("rk"))
    ends = rows.agg(F.min("rk").alias("lo"), F.max("rk").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    axis = F.try_divide(F.col("rk") - lo, hi - lo)
    return rows.select("gene", "organ", "stage", rounded(axis).alias("axis"))


@query(
    "vector_distances",
    f"""
, c AS (SELECT label, {', '.join(f'avg(vec[{i}]::DOUBLE) AS m{i}' for i in range(1, 65))} FROM emb GROUP BY label)
SELECT id, emb.label, {r('sqrt(' + ' + '.join(f'(vec[{i}] - m{i}) ** 2' for i in range(1, 65)) + ')', 'distance')}
FROM emb JOIN c ON emb.label = c.label""",
    ("emb",),
)
def vector_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each vector to its class mean, dimension-wise means joined back."""
    emb = roles.emb(spark, sf)
    means = emb.groupBy("label").agg(
        F.array(*[F.avg(F.get("vec", F.lit(i)).cast("double")) for i in range(64)]).alias("mean")
    )
    d = fm.euclidean(F.col("vec"), F.col("mean"))
    return emb.join(means, "label").select("id", "label", rounded(d).alias("distance"))


