"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenlab.llm import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (op01, op02, op03, op04, op05, op06, op07, op08, op09, op10, op11, op12, op13):
    QUERIES[_module.NAME] = _module.query
    if _module.SQL:
        ORACLES[_module.NAME] = _module.SQL
