"""Run every query against its SQL answer: ``python tests/check_queries.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, db, folder: str, name: str, query, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    found = query(spark, folder)
    left = rows_of(found.columns, found.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} and {sorted(names)}"
    kinds = dict(found.dtypes)
    for d in result.description:
        same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if same.get(kinds[d[0]]) != str(d[1]):
            return f"type of {d[0]}: {kinds[d[0]]} and {d[1]}"
    if len(left) != len(right):
        return f"{len(left)} rows and {len(right)}"
    if left != right:
        first = next((a, b) for a, b in zip(left, right) if a != b)
        n = sum(a != b for a, b in zip(left, right))
        return f"{n} of {len(left)} rows differ, first {first}"
    return "no rows" if not left else None


def main() -> None:
    from conftest import new_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, db = new_session(), connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            problem = compare(spark, db, folder, name, query, oracles[name]) if name in oracles else "no SQL"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - began:6.2f}s  {problem or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
