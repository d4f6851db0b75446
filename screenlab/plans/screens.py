"""Guide- and gene-level outcome queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.functions import maths as fm
from screenlab.operators import metrics, screen
from screenlab.operators.ordered import with_rank
from screenlab.plans import roles
from screenlab.plans.registry import query, round_all, rounded
from screenlab.plans.sqltext import ap_auroc, avg_rank, corr, r

CELLS = roles.CELLS
_STRENGTH = "least(-log10(greatest(p, 1e-12)), 8e0)"
_OUT = f"""
, o AS (SELECT target, cell, label, label * 1e0 AS x_label, {_STRENGTH} AS x_strength, -fc AS x_depletion,
   greatest(-fc, 0e0) AS x_effect FROM gene)
"""
_SIGNED = "CASE WHEN fc < 0 THEN -log10(greatest(p, 1e-12)) ELSE log10(greatest(p, 1e-12)) END"


@query(
    "hit_labels",
    f"""SELECT target, cell, CAST(p < 0.05 AND fc < 0 AS INT) AS hit, {r(_STRENGTH, 'strength')},
  {r(_SIGNED, 'signed_logp')}, {r('greatest(-fc, 0)', 'effect')} FROM gene""",
    ("gene",),
)
def hit_labels(spark: SparkSession, sf: str) -> DataFrame:
    p, fc = F.col("p"), F.col("fc")
    return roles.gene(spark, sf).select(
        "target",
        "cell",
        screen.hit().alias("hit"),
        rounded(fm.strength(p)).alias("strength"),
        rounded(fm.signed_log_p(p, fc)).alias("signed_logp"),
        rounded(fm.effect(fc)).alias("effect"),
    )


@query(
    "filtered_records",
    "SELECT guide, target, rep, fc FROM screen WHERE cell = 'RF' AND day = 14",
    ("screen",),
)
def filtered_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = screen.filter_records(roles.screen(spark, sf), "RF", 14)
    return rows.select("guide", "target", "rep", "fc")


@query(
    "group_restriction",
    """SELECT target, cell, p, fc FROM gene
WHERE target IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')""",
    ("gene",),
)
def group_restriction(spark: SparkSession, sf: str) -> DataFrame:
    groups = roles.table(spark, sf, "part").select(
        F.col("p_partkey").alias("target"), F.col("p_brand").alias("group")
    )
    rows = screen.targets_of_group(roles.gene(spark, sf), groups, "Brand#13")
    return rows.select("target", "cell", "p", "fc")


@query(
    "annotated_guides",
    """SELECT guide, cell, coalesce(p_name, '') AS neighbour, coalesce(p_size, -1) AS distance
FROM screen LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = target""",
    ("screen",),
)
def annotated_guides(spark: SparkSession, sf: str) -> DataFrame:
    """Left lookup; a target without annotation gets the defaults."""
    notes = (
        roles.table(spark, sf, "part")
        .where(F.col("p_size") > 10)
        .select(F.col("p_partkey").alias("target"), "p_name", "p_size")
    )
    return (
        roles.screen(spark, sf)
        .join(notes, "target", "left")
        .select(
            "guide",
            "cell",
            F.coalesce("p_name", F.lit("")).alias("neighbour"),
            F.coalesce("p_size", F.lit(-1)).alias("distance"),
        )
    )


@query(
    "group_rates",
    f"""SELECT cell, count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, {r('avg(label)', 'rate')},
  count(DISTINCT target) AS targets FROM gene GROUP BY cell""",
    ("gene",),
)
def group_rates(spark: SparkSession, sf: str) -> DataFrame:
    return roles.gene(spark, sf).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("hits"),
        rounded(F.avg("label")).alias("rate"),
        F.count_distinct("target").alias("targets"),
    )


@query(
    "ever_positive",
    "SELECT target, bool_or(label = 1) AS ever, count(*) AS cells FROM gene GROUP BY target",
    ("gene",),
)
def ever_positive(spark: SparkSession, sf: str) -> DataFrame:
    return roles.gene(spark, sf).groupBy("target").agg(
        F.bool_or(F.col("label") == 1).alias("ever"), F.count(F.lit(1)).alias("cells")
    )


def _loo_sql(stats: bool = True) -> str:
    cols = []
    for o in screen.OUTCOMES:
        cols += [
            r(f"avg(b.x_{o})", f"{o}_mean"),
            r(f"max(b.x_{o})", f"{o}_max"),
            r(f"min(b.x_{o})", f"{o}_min"),
            r(f"stddev_pop(b.x_{o})", f"{o}_std"),
        ]
    return ", ".join(cols)


_LOO_NAMES = [f"{o}_{s}" for o in screen.OUTCOMES for s in ("mean", "max", "min", "std")]


@query(
    "cross_cell_priors",
    _OUT
    + f"""SELECT a.target, a.cell, count(b.cell) AS sources, {_loo_sql()}
FROM o a LEFT JOIN o b ON a.target = b.target AND a.cell <> b.cell GROUP BY a.target, a.cell""",
    ("gene",),
)
def cross_cell_priors(spark: SparkSession, sf: str) -> DataFrame:
    out = screen.cross_cell_priors(roles.gene(spark, sf))
    return round_all(out.select("target", "cell", "sources", *_LOO_NAMES), _LOO_NAMES)


@query(
    "cross_cell_priors_held_out",
    _OUT
    + f"""SELECT a.target, a.cell, {_loo_sql()}
FROM o a LEFT JOIN o b ON a.target = b.target AND a.cell <> b.cell AND b.cell <> 'NO'
GROUP BY a.target, a.cell""",
    ("gene",),
)
def cross_cell_priors_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """The held-out cell is neither its own source nor anyone else's."""
    return round_all(screen.cross_cell_priors(roles.gene(spark, sf), "NO"), _LOO_NAMES)


@query(
    "training_cell_priors",
    _OUT
    + f"""
, t AS (SELECT target, {', '.join(f"avg(x_{o}) AS {o}_mean, max(x_{o}) AS {o}_max" for o in screen.OUTCOMES)}
  FROM o WHERE cell <> 'AF' GROUP BY target)
SELECT o.target, {', '.join(r(f'{o}_{s}', f'prior_{o}_{s}') for o in screen.OUTCOMES for s in ('mean', 'max'))}
FROM o LEFT JOIN t USING (target) WHERE cell = 'AF'""",
    ("gene",),
)
def training_cell_priors(spark: SparkSession, sf: str) -> DataFrame:
    rows = screen.with_outcomes(roles.gene(spark, sf))
    priors = screen.training_priors(rows.where(F.col("cell") != "AF"))
    valid = rows.where(F.col("cell") == "AF").select("target").join(priors, "target", "left")
    names = [f"{o}_{s}" for o in screen.OUTCOMES for s in ("mean", "max")]
    return valid.select("target", *[rounded(n).alias(f"prior_{n}") for n in names])


def _source_sql() -> str:
    wide, out = [], []
    for c in CELLS:
        wide.append(f"max(CASE WHEN cell = '{c}' THEN 1e0 END) AS {c}_available")
        out.append(
            f"CASE WHEN o.cell = '{c}' THEN 0 ELSE coalesce({c}_available, 0) END AS source_{c}_available"
        )
        for m in screen.OUTCOMES:
            wide.append(f"max(CASE WHEN cell = '{c}' THEN x_{m} END) AS {c}_{m}")
            out.append(
                r(f"CASE WHEN o.cell = '{c}' THEN 0 ELSE coalesce({c}_{m}, 0) END", f"source_{c}_{m}")
            )
    return (
        _OUT
        + f", w AS (SELECT target, {', '.join(wide)} FROM o WHERE cell <> 'RO' GROUP BY target)\n"
        + f"SELECT target, o.cell, {', '.join(out)} FROM o LEFT JOIN w USING (target)"
    )


@query("source_cell_pivot", _source_sql(), ("gene",))
def source_cell_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = screen.source_pivot(roles.gene(spark, sf), CELLS, "RO")
    return round_all(out, [c for c in out.columns if c not in ("target", "cell")])


_REPS = """
, reps AS (SELECT target, cell, guide %% 2 AS guide,
   CAST(sum(fc100) FILTER (rep = 1) AS BIGINT) / (count(*) FILTER (rep = 1) * 100e0) AS rep1,
   CAST(sum(fc100) FILTER (rep = 2) AS BIGINT) / (count(*) FILTER (rep = 2) * 100e0) AS rep2
  FROM screen GROUP BY target, cell, guide %% 2)
, good AS (SELECT * FROM reps WHERE isfinite(rep1) AND isfinite(rep2))
, each AS (SELECT cell, target, -rep1 AS d FROM good UNION ALL SELECT cell, target, -rep2 FROM good)
, s1 AS (SELECT cell, target, avg(d) AS depletion_mean, median(d) AS depletion_median, max(d) AS depletion_max,
   min(d) AS depletion_min, stddev_pop(d) AS depletion_std, quantile_cont(d, 0.75) AS depletion_q75,
   avg(CAST(d > 0 AS INT)) AS fraction_depleted, avg(CAST(d > 0.5 * 0.05e0 AS INT)) AS fraction_depleted_0p5,
   avg(CAST(d > 1.0 * 0.05e0 AS INT)) AS fraction_depleted_1p0 FROM each GROUP BY cell, target)
, s2 AS (SELECT cell, target, avg(-(rep1 + rep2) / 2) AS mean_depletion_mean, median(-(rep1 + rep2) / 2) AS mean_depletion_median,
   max(-(rep1 + rep2) / 2) AS mean_depletion_max, stddev_pop(-(rep1 + rep2) / 2) AS mean_depletion_std,
   avg(CAST(rep1 < 0 AND rep2 < 0 AS INT)) AS fraction_both_reps_depleted,
   avg(CAST(rep1 < -0.5 * 0.05e0 AND rep2 < -0.5 * 0.05e0 AS INT)) AS fraction_both_reps_depleted_0p5,
   coalesce(%s, 0) AS replicate_correlation, avg(abs(rep1 - rep2)) AS mean_replicate_abs_difference,
   count(*) AS guide_count FROM good GROUP BY cell, target)
, summ AS (SELECT cell, target, %s
  FROM (SELECT DISTINCT cell, target FROM reps) LEFT JOIN s1 USING (cell, target) LEFT JOIN s2 USING (cell, target))
""" % (
    corr("rep1", "rep2"),
    ", ".join(f"coalesce({s}, 0e0) AS {s}" for s in screen.GUIDE_STATS),
)


def _replicates(spark: SparkSession, sf: str) -> DataFrame:
    def rep(k: int):
        part = F.when(F.col("rep") == k, F.col("fc100"))
        return F.try_divide(F.sum(part), F.count(part) * F.lit(100.0)).alias(f"rep{k}")

    return (
        roles.screen(spark, sf)
        .groupBy("target", "cell", (F.col("guide") % 2).alias("guide"))
        .agg(rep(1), rep(2))
    )


@query(
    "guide_outcome_summary",
    _REPS + f"SELECT cell, target, {', '.join(r(s, s) for s in screen.GUIDE_STATS)} FROM summ",
    ("screen",),
)
def guide_outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = screen.guide_outcomes(_replicates(spark, sf), scale=0.05)
    return round_all(out, list(screen.GUIDE_STATS))


_ACROSS = screen.GUIDE_STATS


def _across_sql() -> str:
    wide, out = [], []
    for n in _ACROSS:
        for c in CELLS:
            wide.append(f"max(CASE WHEN cell = '{c}' THEN {n} END) AS {c}_{n}")
            out.append(
                r(f"CASE WHEN g.cell = '{c}' THEN 0 ELSE coalesce({c}_{n}, 0) END", f"source_{c}_{n}")
            )
        known = (
            "list_filter(["
            + ", ".join(f"CASE WHEN g.cell <> '{c}' THEN coalesce({c}_{n}, 0) END" for c in CELLS)
            + "], lambda x: x IS NOT NULL)"
        )
        out += [
            r(f"list_avg({known})", f"aggregate_mean_{n}"),
            r(f"list_max({known})", f"aggregate_max_{n}"),
            r(f"list_min({known})", f"aggregate_min_{n}"),
            r(f"list_stddev_pop({known})", f"aggregate_std_{n}", 6),
        ]
    return (
        _REPS
        + f", w AS (SELECT target, {', '.join(wide)} FROM summ GROUP BY target)\n"
        + f"SELECT target, g.cell, {', '.join(out)} FROM gene g LEFT JOIN w USING (target)"
    )


@query("guide_outcomes_across_cells", _across_sql(), ("screen", "gene"))
def guide_outcomes_across_cells(spark: SparkSession, sf: str) -> DataFrame:
    summary = screen.guide_outcomes(_replicates(spark, sf), scale=0.05)
    out = screen.guide_outcomes_across(roles.gene(spark, sf), summary, CELLS, _ACROSS)
    names = [c for c in out.columns if c not in ("target", "cell")]
    coarse = [c for c in names if c.startswith("aggregate_std")]
    return round_all(round_all(out, [c for c in names if c not in coarse]), coarse, 6)


@query(
    "gene_level_scorers",
    f"""SELECT target, {r('-avg(fc)', 'neg_mean_fc')}, {r('-min(fc)', 'neg_min_fc')},
  {r('-max(fc)', 'neg_max_fc')}, {r('-median(fc)', 'neg_median_fc')}, {r('sum(label)', 'hit_count')},
  {r(f'avg({_SIGNED})', 'mean_signed_logp')}, {r(f'max({_SIGNED})', 'max_signed_logp')},
  {r('avg(fc * log10(greatest(p, 1e-12)))', 'mean_fc_x_logp')}
FROM gene WHERE cell <> 'RF' GROUP BY target""",
    ("gene",),
)
def gene_level_scorers(spark: SparkSession, sf: str) -> DataFrame:
    out = screen.gene_scores(roles.gene(spark, sf).where(F.col("cell") != "RF"))
    return round_all(out, list(screen.SCORERS))


@query(
    "outcome_summary",
    f"""SELECT target, {r('avg(fc)', 'fc_mean')}, {r('min(fc)', 'fc_min')}, {r('max(fc)', 'fc_max')},
  {r('stddev_pop(fc)', 'fc_std')}, {r('max(fc) - min(fc)', 'fc_range')}, CAST(sum(label) AS BIGINT) AS hits,
  {r(f'avg({_SIGNED})', 'logp_mean')}, {r(f'max({_SIGNED})', 'logp_max')} FROM gene GROUP BY target""",
    ("gene",),
)
def outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = screen.outcome_summary(roles.gene(spark, sf))
    return round_all(out, [c for c in out.columns if c not in ("target", "hits")])


@query(
    "baseline_submission",
    """
, m AS (SELECT target, avg(fc) AS m FROM gene WHERE cell <> 'RO' GROUP BY target)
SELECT target, cell, round(coalesce(-m, 0), 6) + 0e0 AS y_pred_proba
FROM gene LEFT JOIN m USING (target) WHERE cell = 'RO'""",
    ("gene",),
)
def baseline_submission(spark: SparkSession, sf: str) -> DataFrame:
    gene = roles.gene(spark, sf)
    train = gene.where(F.col("cell") != "RO")
    keys = gene.where(F.col("cell") == "RO").select("target", "cell")
    return screen.baseline_submission(train, keys)


@query(
    "hit_set_jaccard",
    f"""
, c AS (SELECT DISTINCT cell FROM gene)
, p AS (SELECT a.cell AS cell_a, b.cell AS cell_b,
  (SELECT count(*) FROM (SELECT target FROM gene WHERE label = 1 AND cell = a.cell
     INTERSECT SELECT target FROM gene WHERE label = 1 AND cell = b.cell)) AS shared,
  (SELECT count(*) FROM (SELECT target FROM gene WHERE label = 1 AND cell = a.cell
     UNION SELECT target FROM gene WHERE label = 1 AND cell = b.cell)) AS joint
  FROM c a CROSS JOIN c b)
SELECT cell_a, cell_b, shared, joint, {r('shared / greatest(joint, 1)', 'jaccard')} FROM p""",
    ("gene",),
)
def hit_set_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(screen.hit_overlaps(roles.gene(spark, sf), CELLS), ["jaccard"])


@query(
    "single_source_transfer",
    """
, rows AS (SELECT a.cell || '>' || b.cell AS pair, -a.fc AS score, b.label FROM gene a JOIN gene b
  ON a.target = b.target AND a.cell <> b.cell)
"""
    + ap_auroc("rows", "pair")
    + f"SELECT pair, n, n_pos, {r('auprc', 'auprc')}, {r('auprc / (n_pos / n)', 'lift')} FROM ap_out",
    ("gene",),
)
def single_source_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """How well one cell's depletion ranks another cell's hits, with lift over its base rate."""
    pairs = screen.pair_rows(roles.gene(spark, sf), CELLS, ["fc", "label"])
    rows = pairs.select(
        F.concat_ws(">", "source", "cell").alias("pair"),
        (-F.col("source_fc")).alias("score"),
        "label",
    )
    m = metrics.ranking_metrics(rows, ["pair"], "score", "label")
    lift = F.try_divide(F.col("auprc"), F.try_divide(F.col("n_pos"), F.col("n")))
    return round_all(m.select("pair", "n", "n_pos", "auprc", lift.alias("lift")), ["auprc", "lift"])


@query(
    "cell_rank_correlation",
    f"""
, rows AS (SELECT a.cell AS source, b.cell, a.fc AS x, b.fc AS y FROM gene a JOIN gene b
  ON a.target = b.target AND a.cell <> b.cell)
, rk AS (SELECT source, cell, {avg_rank('x', 'source, cell')} AS rx, {avg_rank('y', 'source, cell')} AS ry FROM rows)
SELECT source, cell, count(*) AS n, {r(corr('rx', 'ry'), 'rho')} FROM rk GROUP BY source, cell""",
    ("gene",),
)
def cell_rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = screen.pair_rows(roles.gene(spark, sf), CELLS, ["fc"])
    by = ["source", "cell"]
    ranked = with_rank(with_rank(pairs, by, "source_fc", "_rx"), by, "fc", "_ry")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(metrics.guarded_corr(F.col("_rx"), F.col("_ry"))).alias("rho"),
    )


@query(
    "free_text_numbers",
    """SELECT event_id, CAST(nullif(regexp_extract(props, '[-+]?[0-9]+\\.?[0-9]*'), '') AS DOUBLE) AS k
FROM events""",
)
def free_text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return roles.table(spark, sf, "events").select("event_id", fm.first_number(F.col("props")).alias("k"))


@query("free_text_numbers_in_documents")
def free_text_numbers_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The look-behind matters here: digits glued to letters are not numbers."""
    return roles.table(spark, sf, "documents").select(
        "doc_id", fm.first_number(F.col("text")).alias("first_number")
    )


@query(
    "json_map_rows",
    """SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS INT) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""",
)
def json_map_rows(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "map<string,int>")
    return roles.table(spark, sf, "events").select(
        "event_id", F.explode(parsed).alias("key", "value")
    )


@query(
    "leak_audit",
    """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM gene""",
    ("gene",),
)
def leak_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out features before and after the held-out outcomes are altered: none may move."""
    gene = roles.gene(spark, sf)
    held = F.col("cell") == "NF"
    mutated = gene.withColumns(
        {
            "p": F.when(held, F.lit(0.5)).otherwise(F.col("p")),
            "fc": F.when(held, F.lit(-9.0)).otherwise(F.col("fc")),
            "label": F.when(held, 1 - F.col("label")).otherwise(F.col("label")),
        }
    )

    def digest(df: DataFrame, out: str) -> DataFrame:
        feats = round_all(screen.cross_cell_priors(df, "NF"), _LOO_NAMES)
        return feats.select("target", "cell", F.xxhash64(*_LOO_NAMES).alias(out))

    both = digest(gene, "a").join(digest(mutated, "b"), ["target", "cell"], "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("changed"))


@query(
    "target_level_means",
    _OUT
    + f"""SELECT target, {r('avg(x_strength)', 'strength')}, {r('avg(x_depletion)', 'depletion')},
  CAST(sum(label) AS BIGINT) AS hits, {r('max(x_strength)', 'strength_max')} FROM o GROUP BY target""",
    ("gene",),
)
def target_level_means(spark: SparkSession, sf: str) -> DataFrame:
    """Rows collapsed to their target: feature means, label sum, strongest signal."""
    rows = screen.with_outcomes(roles.gene(spark, sf))
    return rows.groupBy("target").agg(
        rounded(F.avg("strength")).alias("strength"),
        rounded(F.avg("depletion")).alias("depletion"),
        F.sum("label").alias("hits"),
        rounded(F.max("strength")).alias("strength_max"),
    )


@query(
    "finite_replicate_pairs",
    _REPS + "SELECT cell, target, guide, rep1, rep2 FROM good",
    ("screen",),
)
def finite_replicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Guides whose two replicates are both there and finite."""
    rows = screen.finite_pairs(_replicates(spark, sf), "rep1", "rep2")
    return rows.select("cell", "target", "guide", "rep1", "rep2")


@query(
    "kept_cells",
    "SELECT target, cell, label FROM gene WHERE cell NOT IN ('NF', 'NO') AND cell IN ('RF', 'NF', 'AF')",
    ("gene",),
)
def kept_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Exclude and keep-only lists together; nothing left would be an error."""
    rows = screen.keep_cells(roles.gene(spark, sf), exclude=["NF", "NO"], only=["RF", "NF", "AF"])
    return rows.select("target", "cell", "label")


@query(
    "asserted_rows",
    f"SELECT target, cell, {r('p', 'p')} FROM gene",
    ("gene",),
)
def asserted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that pass the leak checks: no share outside 0 to 1, no answer among the columns."""
    rows = roles.gene(spark, sf).select("target", "cell", "p")
    p = F.col("p")
    fine = screen.assert_none(rows, p.isNull() | (p < 0) | (p > 1), "p outside 0 to 1")
    return round_all(screen.assert_no_columns(fine, ["label", "fc"]), ["p"])
