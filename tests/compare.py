"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

usage: python tests/compare.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


# Spark type -> the DuckDB type that holds the same values
_SAME = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "date": "DATE",
}


def _duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return _duck_type(spark_type[6:-1]) + "[]"
    return _SAME.get(spark_type, spark_type)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when both sides hold the same rows."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if cols != names:
        return [f"columns {cols} != {names}"]
    problems = []
    types = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    for name, kind in df.dtypes:
        if _duck_type(kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    left = [_plain(tuple(r[c] for c in cols)) for r in df.collect()]
    at = [rel.columns.index(c) for c in cols]
    right = [_plain(tuple(r[i] for i in at)) for r in rel.fetchall()]
    left.sort(key=_key)
    right.sort(key=_key)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    if not left:
        problems.append("no rows")
    differ = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if differ:
        problems.append(f"{len(differ)} rows differ, first:\n   {differ[0][0]}\n   {differ[0][1]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from screenlab.session import local_session

    sf, *wanted = sys.argv[1:]
    spark = local_session("8")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = plan(spark, sf)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = f"{df.count() if problems else ''}"
            else:
                rows = df.collect()
                problems = [] if rows else ["no rows"]
                note = f"rows only: {len(rows)}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problems, note = [f"{type(error).__name__}: {str(error)[:700]}"], ""
        took = time.time() - start
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name:44s} {took:6.1f}s {note}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
