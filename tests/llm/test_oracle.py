"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from pointloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or v != v else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    there = con.execute(oracle_sql()[name])
    names = [d[0] for d in there.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in there.fetchall()), key=str)
