"""Queries of the text problems on the smallest tables: against their SQL twins, else for rows and columns."""

import glob
import os

import duckdb
import pytest

import verify
from quern.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in queries.SQL:
        rel = con.execute(queries.SQL[name])
        columns = [c[0] for c in rel.description]
        assert sorted(df.columns) == sorted(columns)
        assert verify.rows(df.columns, rows) == verify.rows(columns, rel.fetchall())
    else:
        assert rows and len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)
