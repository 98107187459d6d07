"""Every query of the grid engine against DuckDB, on the smallest tables."""

import duckdb
import pytest

from pointloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows
    if name in catalogue.oracle_sql():
        there = duck.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in there.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in there.fetchall()), key=str)
        assert rows == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
