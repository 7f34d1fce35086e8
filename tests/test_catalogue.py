"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from plinth.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple(str(x) if not isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    own = sorted(key(r[c] for c in columns) for r in df.collect())
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert own == sorted(key(r[i] for i in at) for r in rel.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
