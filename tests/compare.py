"""Run registered queries against their SQL: ``python tests/compare.py <folder> [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as driver  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    result = connection.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def normal(rows, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, bool) or value is None:
            return value
        if isinstance(value, float) and value.is_integer() and not math.isinf(value):
            return int(value)
        return value

    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=repr)


def differences(spark, folder: str, name: str) -> tuple[int, list]:
    """Row count and the first rows that differ."""
    df = driver.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if name not in driver.oracle_sql():
        return len(rows), []
    columns, expected = sql_rows(folder, driver.oracle_sql()[name])
    if sorted(columns) != sorted(df.columns):
        return len(rows), [("columns", sorted(df.columns), sorted(columns))]
    mine, theirs = normal(rows, df.columns), normal(expected, columns)
    if len(mine) != len(theirs):
        only = set(mine) ^ set(theirs)
        return len(rows), [("rows", len(mine), len(theirs)), *list(only)[:4]]
    return len(rows), [(a, b) for a, b in zip(mine, theirs) if a != b][:4]


if __name__ == "__main__":
    from tollgate.session import drop_scratch, local_session

    session = local_session(8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-")})
    session.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(driver.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            rows, found = differences(session, sys.argv[1], name)
        except Exception as error:
            rows, found = -1, [type(error).__name__, str(error)[:1500]]
        drop_scratch(session)
        bad += bool(found)
        kind = "sql" if name in driver.oracle_sql() else "rows only"
        print(f"{'DIFFERS' if found else 'ok':8}{name:34}{rows:8} {kind:10}{time.time() - start:6.1f}s", flush=True)
        for f in found:
            print("        ", f)
    print(f"{len(names)} queries, {bad} differ")
