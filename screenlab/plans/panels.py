"""Expression-panel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.operators import annotation, panels
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all
from screenlab.plans.sqltext import corr, pct_rank, r

SAMPLES = roles.SAMPLES
_GRID = f"""
, grid AS (SELECT gene, sample, coalesce(value, 0e0) AS v FROM (SELECT DISTINCT gene FROM panel)
  CROSS JOIN (SELECT unnest({list(SAMPLES)}) AS sample) LEFT JOIN panel USING (gene, sample))
"""
# the second panel: expensive events only
_MRNA = """
, mrna AS (SELECT user_id AS gene, event_type AS sample,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100e0) AS value
  FROM events WHERE value > 20 GROUP BY user_id, event_type)
"""
# rows to describe: every (target, cell), cells standing for samples
_ROWS = f"""
, rows AS (SELECT target AS gene, {list(SAMPLES)}[(ascii(cell) + ascii(substring(cell, 2, 1))) % 5 + 1] AS sample, cell FROM gene)
"""


def _mrna(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return (
        roles.table(spark, sf, "events")
        .where(F.col("value") > 20)
        .groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("sample"))
        .agg((cents / (F.count(F.lit(1)) * F.lit(100.0))).alias("value"))
    )


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.ascii("cell") + F.ascii(F.substring("cell", 2, 1))) % 5
    return roles.gene(spark, sf).select(
        F.col("target").alias("gene"),
        F.get(F.array(*[F.lit(s) for s in SAMPLES]), at).alias("sample"),
        "cell",
    )


def _features(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return round_all(df, [c for c in df.columns if c not in keys])


@query(
    "expression_specificity",
    _GRID
    + f"""
, g AS (SELECT gene, sum(v) AS s, avg(v) AS m, max(v) AS t, stddev_pop(v) AS sd, count(*) AS n FROM grid GROUP BY gene)
, e AS (SELECT gene, sum(CASE WHEN v > 0 THEN -(v / s) * ln(v / s) END) AS h FROM grid JOIN g USING (gene) GROUP BY gene)
SELECT a.gene, a.sample, {r('ln(1 + any_value(a.v))', 'matched_log')},
  {r('avg(ln(1 + b.v)) FILTER (b.sample <> a.sample)', 'other_mean_log')},
  {r('max(ln(1 + b.v)) FILTER (b.sample <> a.sample)', 'other_max_log')},
  {r('log2((any_value(a.v) + 0.1) / (avg(b.v) FILTER (b.sample <> a.sample) + 0.1))', 'matched_vs_other_log2_ratio')},
  {r('any_value(a.v) / greatest(any_value(s), 1e-6)', 'matched_fraction')},
  {r('avg(CAST(b.v <= a.v AS INT))', 'matched_within_gene_percentile')},
  {r('any_value(sd) / greatest(any_value(m), 1e-6)', 'cross_cell_cv')},
  {r('CASE WHEN any_value(t) > 0 THEN sum(1 - b.v / t) / (any_value(n) - 1) ELSE 0 END', 'cross_cell_tau')},
  {r('coalesce(any_value(h), 0) / ln(any_value(n))', 'cross_cell_entropy')},
  count(*) FILTER (b.v > 0) * 1e0 AS expressing_cell_count, count(*) FILTER (b.v >= 1) * 1e0 AS cell_count_tpm_ge_1
FROM grid a JOIN grid b USING (gene) JOIN g USING (gene) JOIN e USING (gene) GROUP BY a.gene, a.sample""",
    ("panel",),
)
def expression_specificity(spark: SparkSession, sf: str) -> DataFrame:
    return _features(panels.specificity(roles.panel(spark, sf), SAMPLES), ("gene", "sample"))


@query(
    "expression_global_percentile",
    f"SELECT gene, sample, value, {r(pct_rank('value', 'sample'), 'global_percentile')} FROM panel",
    ("panel",),
)
def expression_global_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(panels.global_percentile(roles.panel(spark, sf)), ["global_percentile"])


def _own_sql() -> str:
    return (
        _GRID
        + _MRNA
        + _ROWS
        + f"""
, g AS (SELECT gene, avg(v) AS m, count(*) FILTER (v >= 1) AS breadth FROM grid GROUP BY gene)
SELECT rows.gene, rows.sample, rows.cell, {r('ln(1 + coalesce(v, 0))', 'log_tpm_own_total')},
  {r('ln(1 + coalesce(mrna.value, 0))', 'log_tpm_own_mrna')}, {r('ln(1 + coalesce(m, 0))', 'log_tpm_panel_mean')},
  coalesce(breadth, 0) * 1e0 AS tpm_breadth, {r('coalesce(v, 0) / (coalesce(m, 0) + 1e-6)', 'tpm_specificity')},
  CAST(coalesce(v, 0) >= 1 AS INT) * 1e0 AS tpm_expressed, CAST(m IS NULL AS INT) * 1e0 AS missing
FROM rows LEFT JOIN g USING (gene) LEFT JOIN grid ON grid.gene = rows.gene AND grid.sample = rows.sample
LEFT JOIN mrna ON mrna.gene = rows.gene AND mrna.sample = rows.sample"""
    )


@query("own_expression_block", _own_sql(), ("panel", "gene"))
def own_expression_block(spark: SparkSession, sf: str) -> DataFrame:
    out = panels.own_expression(
        _rows(spark, sf), roles.panel(spark, sf), _mrna(spark, sf), SAMPLES
    )
    return _features(out, ("gene", "sample", "cell"))


def _matched_sql() -> str:
    cols = []
    for s in SAMPLES:
        cols += [
            r(f"ln(1 + coalesce(t_{s}, 0))", f"total_log_{s}"),
            f"CAST(coalesce(t_{s}, 0) > 0 AS INT) * 1e0 AS total_present_{s}",
            r(f"ln(1 + coalesce(m_{s}, 0))", f"mrna_log_{s}"),
            f"CAST(coalesce(m_{s}, 0) > 0 AS INT) * 1e0 AS mrna_present_{s}",
        ]
    tw = ", ".join(f"max(CASE WHEN sample = '{s}' THEN value END) AS t_{s}" for s in SAMPLES)
    mw = ", ".join(f"max(CASE WHEN sample = '{s}' THEN value END) AS m_{s}" for s in SAMPLES)
    own_t = "ln(1 + coalesce(CASE sample " + " ".join(f"WHEN '{s}' THEN t_{s}" for s in SAMPLES) + " END, 0))"
    own_m = own_t.replace("t_", "m_")
    return (
        _MRNA
        + _ROWS
        + f"""
, tw AS (SELECT gene, max(value) AS tmax, {tw} FROM panel GROUP BY gene)
, mw AS (SELECT gene, max(value) AS mmax, {mw} FROM mrna GROUP BY gene)
SELECT rows.gene, sample, cell, {', '.join(cols)}, {r(own_t, 'matched_total_log')}, {r(own_m, 'matched_mrna_log')},
  {r(f'{own_m} - {own_t}', 'matched_mrna_minus_total')},
  {r(f'{own_t} / greatest(ln(1 + coalesce(tmax, 0)), 1e-6)', 'matched_total_fraction_max')},
  {r(f'{own_m} / greatest(ln(1 + coalesce(mmax, 0)), 1e-6)', 'matched_mrna_fraction_max')}
FROM rows LEFT JOIN tw USING (gene) LEFT JOIN mw USING (gene)"""
    )


@query("matched_expression_block", _matched_sql(), ("panel", "gene"))
def matched_expression_block(spark: SparkSession, sf: str) -> DataFrame:
    out = panels.matched_expression(
        _rows(spark, sf), roles.panel(spark, sf), _mrna(spark, sf), SAMPLES
    )
    return _features(out, ("gene", "sample", "cell"))


def _neighbour_sql() -> str:
    wide = ", ".join(f"max(CASE WHEN sample = '{s}' THEN value END) AS t_{s}" for s in SAMPLES)
    own = "CASE sample " + " ".join(f"WHEN '{s}' THEN t_{s}" for s in SAMPLES) + " END"
    return (
        _MRNA
        + _ROWS
        + f"""
, w AS (SELECT gene AS neighbour, {wide}, avg(value) AS a, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd
  FROM mrna GROUP BY gene)
SELECT rows.gene, cell, sample, rows.gene % 200 AS neighbour, {r(f'coalesce({own}, 0)', 'matched')},
  CAST(({own}) IS NULL AS INT) * 1e0 AS matched_missing,
  {', '.join(r(f'coalesce(t_{s}, 0)', f'value_{s}') for s in SAMPLES)},
  {r('coalesce(a, 0)', 'value_mean')}, {r('coalesce(lo, 0)', 'value_min')}, {r('coalesce(hi, 0)', 'value_max')},
  {r('coalesce(sd, 0)', 'value_std', 6)}
FROM rows LEFT JOIN w ON w.neighbour = rows.gene % 200"""
    )


@query("neighbour_profile_block", _neighbour_sql(), ("gene",))
def neighbour_profile_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf).withColumn("neighbour", F.col("gene") % 200)
    out = panels.neighbour_profile(rows, _mrna(spark, sf), SAMPLES)
    keys = ("gene", "sample", "cell", "neighbour", "value_std")
    return round_all(_features(out, keys), ["value_std"], 6)


@query(
    "expression_profile_design",
    _GRID
    + f"""
, g AS (SELECT gene, avg(ln(1 + v)) AS m, max(ln(1 + v)) AS hi, min(ln(1 + v)) AS lo, stddev_pop(ln(1 + v)) AS sd,
   count(*) FILTER (v > 1) AS ex FROM grid GROUP BY gene)
SELECT gene, sample, {r('m', 'log_mean')}, {r('hi', 'log_max')}, {r('lo', 'log_min')}, {r('sd', 'log_std')},
  ex * 1e0 AS expressed, {r('ln(1 + v)', 'own_log')}, {r('ln(1 + v) - m', 'own_deviation')}
FROM grid JOIN g USING (gene)""",
    ("panel",),
)
def expression_profile_design(spark: SparkSession, sf: str) -> DataFrame:
    return _features(panels.profile(roles.panel(spark, sf), SAMPLES), ("gene", "sample"))


_STAGE = f"""CASE WHEN stage LIKE '%wpc' THEN CAST(replace(stage, 'wpc', '') AS DOUBLE)
   ELSE list_position({list(roles.POSTNATAL)}, stage) + 99e0 END"""


@query(
    "developmental_blocks",
    f"""
, s AS (SELECT *, ln(1 + value) AS lg, {_STAGE} AS rk, stage LIKE '%wpc' AS pre FROM atlas)
, a AS (SELECT *, (rk - (SELECT min(rk) FROM s)) / ((SELECT max(rk) FROM s) - (SELECT min(rk) FROM s)) AS axis FROM s)
, pk AS (SELECT gene, axis AS peak FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY lg DESC, axis) AS k FROM a) WHERE k = 1)
, og AS (SELECT gene, count(*) FILTER (m > 1) * 1e0 AS breadth_organs FROM
   (SELECT gene, organ, median(value) AS m FROM atlas GROUP BY gene, organ) GROUP BY gene)
, g AS (SELECT gene, avg(lg) AS lm, max(lg) AS lx, quantile_cont(lg, 0.9) AS lp, stddev_pop(lg) AS ls,
   avg(CAST(value > 1 AS INT)) AS bs, avg(lg) FILTER (pre) AS p, avg(lg) FILTER (NOT pre) AS q FROM a GROUP BY gene)
SELECT gene, {r('lm', 'level_mean')}, {r('lx', 'level_max')}, {r('lp', 'level_p90')}, {r('ls', 'level_sd')},
  {r('bs', 'breadth_share')}, {r('p', 'prenatal')}, {r('q', 'postnatal')}, {r('peak', 'peak')}, breadth_organs,
  {r('p - q', 'timing_difference')} FROM g JOIN pk USING (gene) JOIN og USING (gene)""",
    ("atlas",),
)
def developmental_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _features(panels.developmental(roles.atlas(spark, sf), roles.POSTNATAL), ("gene",))


@query(
    "organ_medians",
    f"""SELECT gene, organ, {r('median(value)', 'median')}, {r('median(ln(1 + value))', 'log_median')}
FROM atlas GROUP BY gene, organ""",
    ("atlas",),
)
def organ_medians(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(panels.organ_levels(roles.atlas(spark, sf)), ["median", "log_median"])


def _coexpression_sql(by: str) -> str:
    def rank(v: str) -> str:
        return (
            f"rank() OVER (PARTITION BY {by} ORDER BY {v})"
            f" + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2e0"
        )

    return f"""
, mk AS (SELECT gene AS marker, organ, stage, value AS mv FROM atlas WHERE gene IN (3, 8))
, p AS (SELECT a.gene, marker, a.organ, a.value, mv FROM atlas a JOIN mk USING (organ, stage))
, k AS (SELECT {by}, {rank('value')} AS ra, {rank('mv')} AS rb FROM p)
SELECT {by}, count(*) AS samples, round(CASE WHEN count(*) >= 3 THEN {corr('ra', 'rb')} END, 9) + 0e0 AS rho
FROM k GROUP BY {by}"""


@query("marker_coexpression", _coexpression_sql("gene, marker"), ("atlas",))
def marker_coexpression(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(panels.coexpression(roles.atlas(spark, sf), [3, 8]), ["rho"])


@query("marker_coexpression_by_organ", _coexpression_sql("gene, marker, organ"), ("atlas",))
def marker_coexpression_by_organ(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(panels.coexpression(roles.atlas(spark, sf), [3, 8], by_organ=True), ["rho"])


_ANNOTATION = """
, ann AS (SELECT p_partkey, p_size, p_retailprice, p_brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS kind,
   CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS effect FROM part)
, cat AS (SELECT p_partkey, unnest([{'c': 'p_brand', 'v': coalesce(p_brand, 'nan')}, {'c': 'kind', 'v': coalesce(kind, 'nan')}]) AS x FROM ann)
, fit AS (SELECT x.c AS "column", x.v AS category, count(*) AS rows FROM cat WHERE p_partkey % 3 <> 0 GROUP BY x.c, x.v)
"""


def _annotation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The annotation table, and the categories of two thirds of its rows."""
    kind = F.when(F.col("p_size") % 7 != 0, F.col("p_type"))
    effect = F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice"))
    part = roles.table(spark, sf, "part").select(
        "p_partkey", "p_size", "p_retailprice", "p_brand", kind.alias("kind"), effect.alias("effect")
    )
    fitted = annotation.fit_categories(part.where(F.col("p_partkey") % 3 != 0), ["p_brand", "kind"])
    return part, fitted


@query("fitted_categories", _ANNOTATION + 'SELECT "column", category, rows FROM fit')
def fitted_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _annotation(spark, sf)[1]


@query(
    "static_annotation_block",
    _ANNOTATION
    + f"""
, long AS (SELECT p_partkey, unnest([
    {{'f': 'p_size', 'v': coalesce(p_size, -1)::DOUBLE}}, {{'f': 'p_retailprice', 'v': coalesce(p_retailprice, -1)::DOUBLE}},
    {{'f': 'log_p_retailprice', 'v': ln(1 + greatest(coalesce(p_retailprice, 0), 0))}},
    {{'f': 'effect', 'v': coalesce(effect, 0)::DOUBLE}}, {{'f': 'effect_missing', 'v': (effect IS NULL)::INT::DOUBLE}}]) AS x FROM ann)
SELECT p_partkey, x.f AS feature, {r('x.v', 'value')} FROM long
UNION ALL SELECT p_partkey, x.c || '_' || x.v, 1e0 FROM cat JOIN fit ON fit."column" = x.c AND fit.category = x.v""",
)
def static_annotation_block(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with -1 for missing, log scale, indicators of all fitted categories, filled external value."""
    part, fitted = _annotation(spark, sf)
    out = annotation.static_annotation(
        part, ["p_partkey"], ["p_size", "p_retailprice"], ["p_retailprice"], ["p_brand", "kind"],
        {"effect": F.col("effect")}, fitted,
    )
    return round_all(out, ["value"])


_LISTS = " || ".join(f"CASE WHEN p_size % {k + 2} = 0 THEN '{s},' ELSE '' END" for k, s in enumerate(SAMPLES))


@query(
    "neighbour_context_blocks",
    f"""
, n AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size - 5 END AS distance, p_type AS class, {_LISTS} AS tissues FROM part)
SELECT p_partkey, 'distance' AS feature, coalesce(distance, -1)::DOUBLE AS value FROM n
UNION ALL SELECT p_partkey, 'log_distance', {r('ln(1 + greatest(coalesce(distance, -1), 0))', 'value')} FROM n
UNION ALL SELECT p_partkey, 'class_' || coalesce(class, 'nan'), 1e0 FROM n
UNION ALL SELECT p_partkey, 'tissues_' || t, 1e0 FROM (SELECT p_partkey, unnest(string_split(tissues, ',')) AS t FROM n) WHERE t <> ''""",
)
def neighbour_context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A neighbour's distance, its class and the tissues listed for it."""
    tissues = F.concat(*[F.when(F.col("p_size") % (k + 2) == 0, f"{s},").otherwise("") for k, s in enumerate(SAMPLES)])
    rows = roles.table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 9 != 0, F.col("p_size") - 5).alias("distance"),
        F.col("p_type").alias("class"),
        tissues.alias("tissues"),
    )
    keys = ["p_partkey"]
    kinds = rows.select("p_partkey", "class")
    out = annotation.distance_block(keys, "distance", rows)
    out = out.unionByName(annotation.one_hot_rows(kinds, keys, annotation.fit_categories(kinds, ["class"])))
    return round_all(out.unionByName(annotation.listed_block(rows, keys, "tissues", SAMPLES)), ["value"])


@query(
    "neighbour_level_block",
    _MRNA
    + f"""
, names AS (SELECT 0 AS src, 'S' || (c_custkey % 60) AS name, c_custkey AS id, c_custkey % 2 AS rank FROM customer
  UNION ALL SELECT 1, 'S' || (s_suppkey % 80), s_suppkey, 0 FROM supplier)
, m AS (SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, rank, id) AS k FROM names) WHERE k = 1)
, t AS (SELECT gene, sample, coalesce(mrna.value, panel.value) AS v FROM panel FULL JOIN mrna USING (gene, sample)
  WHERE sample IN {SAMPLES})
, has AS (SELECT gene, sum(v) / {len(SAMPLES)} AS mean, count(*) FILTER (v >= 1) AS breadth FROM t GROUP BY gene)
, x AS (SELECT p_partkey, 'S' || (p_partkey % 100) AS symbol, unnest({list(SAMPLES)}) AS sample FROM part)
SELECT p_partkey, symbol, x.sample, {r('ln(1 + coalesce(t.v, 0))', 'log_total')},
  {r('CASE WHEN has.gene IS NULL THEN 0 ELSE ln(1 + coalesce(panel.value, 0)) END', 'log_mrna')},
  {r('ln(1 + coalesce(mean, 0))', 'log_mean')}, coalesce(breadth, 0) * 1e0 AS breadth, (has.gene IS NULL)::INT * 1e0 AS missing
FROM x LEFT JOIN m ON m.name = symbol LEFT JOIN has ON has.gene = m.id LEFT JOIN t ON t.gene = m.id AND t.sample = x.sample
LEFT JOIN panel ON panel.gene = m.id AND panel.sample = x.sample""",
    ("panel",),
)
def neighbour_level_block(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of the gene that a symbol leads to, by two maps and two sources in order of preference."""
    rows = roles.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("S"), F.col("p_partkey") % 100).alias("symbol"))
    first = roles.table(spark, sf, "customer").select(
        F.concat(F.lit("S"), F.col("c_custkey") % 60).alias("name"),
        F.col("c_custkey").alias("id"),
        (F.col("c_custkey") % 2).cast("bigint").alias("rank"),
    )
    second = roles.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey") % 80).alias("name"), F.col("s_suppkey").alias("id"), F.lit(0).cast("bigint").alias("rank")
    )
    panel, mrna = roles.panel(spark, sf), _mrna(spark, sf)
    out = annotation.neighbour_levels(rows, [first, second], [mrna, panel], [panel], SAMPLES)
    return round_all(out, ["log_total", "log_mrna", "log_mean"])
