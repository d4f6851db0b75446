"""SQL fragments shared by the check queries."""

from __future__ import annotations


def ap_auroc(source: str, by: str, tag: str = "ap") -> str:
    """CTE ``<tag>_out(by, n, n_pos, auroc, auprc)`` over source(by, score, label)."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    both = "max(tp) > 0 AND max(tp) < max(tn)"
    return f"""
, {tag}_scores AS (SELECT {keys}score, count(*) AS n_s, sum(label) AS pos_s
  FROM {source} GROUP BY {keys}score)
, {tag}_run AS (SELECT *, sum(n_s) OVER w AS cn, sum(pos_s) OVER w AS cp,
    sum(n_s) OVER ({part}) AS tn, sum(pos_s) OVER ({part}) AS tp
  FROM {tag}_scores WINDOW w AS ({part} ORDER BY score DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, {tag}_out AS (SELECT {keys}CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS n_pos,
    CASE WHEN {both} THEN
      sum(pos_s * ((tn - tp - (cn - cp)) + (n_s - pos_s) / 2e0)) / (max(tp) * (max(tn) - max(tp)))
    END AS auroc,
    CASE WHEN {both} THEN sum(pos_s * (cp / cn)) / max(tp) END AS auprc
  FROM {tag}_run {group})
"""


def avg_rank(value: str, by: str = "") -> str:
    """Average rank of ties (1-based)."""
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return (
        f"(rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({ties}) - 1) / 2e0)"
    )


def pct_rank(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"({avg_rank(value, by)} / count(*) OVER ({part}))"


def corr(x: str, y: str) -> str:
    return (
        f"CASE WHEN stddev_pop({x}) > max(abs({x})) * 1e-12"
        f" AND stddev_pop({y}) > max(abs({y})) * 1e-12"
        f" THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    )


def r(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"
