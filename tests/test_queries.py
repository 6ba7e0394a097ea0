"""Every query with a SQL twin gives its rows, on the smallest tables, and queries over texts also on files with something for every rule."""

import glob
import os

import duckdb
import pytest

import verify
from quern import plans
from quern.plans import repositories, scoring
from tests.fixtures import enriched

SF = "/root/testdata/sf0.001"


def views(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return c


def compare(spark, con, name, folder):
    df = plans.all_queries()[name](spark, folder)
    rel = con.execute(plans.all_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    rows = df.collect()
    assert verify.rows(df.columns, rows) == verify.rows(columns, rel.fetchall())
    return rows


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.fixture(scope="module")
def more(spark, tmp_path_factory):
    folder = enriched(spark, SF, str(tmp_path_factory.mktemp("more") / "tables"))
    return folder, views(folder)


@pytest.mark.parametrize("name", sorted(plans.all_sql()))
def test_twin(spark, con, name):
    compare(spark, con, name, SF)


@pytest.mark.parametrize("name", sorted([*scoring.SQL, *(n for n in repositories.SQL if n.startswith("entry")), "behavioral_ladder", "prescreen_short_circuit", "lookup_analysis", "stream_file_scores"]))
def test_twin_where_rules_match(spark, more, name):
    assert compare(spark, more[1], name, more[0])

