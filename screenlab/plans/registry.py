"""Query registry: a name, a Spark plan, and where possible the SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.plans.roles import with_roles

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, roles: tuple[str, ...] = ()):
    """Register a plan; ``sql`` may start with further CTEs (", x AS (...)")."""

    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = with_roles(roles, sql)
        return plan

    return add


def rounded(col: Column | str, digits: int = 9) -> Column:
    """Round and turn -0.0 into 0.0, so that equal results print equally."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def round_all(df: DataFrame, names: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})
