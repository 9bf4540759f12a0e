"""Every registered query equals its SQL over the smallest tables, whole."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from citeloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "events", "pages", "benchmark", "conversations"]
QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, map(tuple, clean.values.tolist())))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert len(got) > 0
    assert rows(got, columns) == rows(expected, columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
