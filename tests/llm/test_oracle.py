"""Registered queries: those with SQL equal it, all read their tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from citeloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "embeddings", "documents", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, expected = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert [str(t) for t in got[columns].dtypes] == [str(t) for t in expected[columns].dtypes]
    rows = [sorted(map(tuple, frame[columns].values.tolist())) for frame in (got, expected)]
    assert len(got) and rows[0] == rows[1]


def test_registered():
    found = entry_module.queries()
    assert sum(name.startswith("op") for name in found) == 13 and "pipeline" in found
    assert set(queries.ORACLE) <= set(entry_module.oracle_sql())
