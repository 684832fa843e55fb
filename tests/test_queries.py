"""Every core query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.plans import catalog
from corpusloom.session import table_scope

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.fixture(autouse=True)
def scoped_tables():
    with table_scope():
        yield


@pytest.mark.parametrize("name", list(dict.fromkeys(catalog.oracle_sql())))
def test_equals_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    cur = tables.cursor()
    r = cur.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    expected = sorted((tuple(plain(v) for v in row) for row in r.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_golden_model_sizes(spark):
    got = {r["name"]: r["total"] for r in catalog.queries()["a31_model_sizes"](spark, SF).collect()}
    assert got == {"wide": 98_324_736, "middle": 50_608_128, "narrow": 4_949_376}


def test_all_steps_ascending(spark, tables):
    got = [r["step"] for r in catalog.queries()["l08_by_step"](spark, SF).collect()]
    assert got == sorted(got) and len(got) == tables.cursor().execute("select count(*) from events").fetchone()[0] > 5
