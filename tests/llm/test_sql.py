"""Queries that SQL can express, against it."""

import duckdb
import pytest

from tenderlake.llm import queries

SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SAMPLE}/documents.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SAMPLE)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
