"""Queries with an SQL answer, side by side."""

from __future__ import annotations

import duckdb
import pytest

from slopeworks.llm.queries import llm_oracles, llm_queries


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = db.execute(llm_oracles()[name])
    names = [d[0] for d in result.description]
    found = llm_queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(result.fetchall())
