"""Every query that has SQL gives the same rows as DuckDB."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# nothing reaches these queries' fixed thresholds at the smallest scale
MAY_BE_EMPTY = {"chromosome_folds", "fold_role_sizes", "restricted_matrix"}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    problems = compare(QUERIES[name](spark, sf), duck, ORACLES[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []
