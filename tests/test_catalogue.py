"""Every catalogue query against its DuckDB counterpart on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from skeinworks.plans import catalogue

DIR = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    got = df.collect()
    r = duck.execute(SQL[name])
    cols = [c[0] for c in r.description]
    want = r.fetchall()
    order = sorted(cols)
    assert order == sorted(df.columns)
    a = sorted((tuple(norm(x[c]) for c in order) for x in got), key=repr)
    b = sorted((tuple(norm(x[cols.index(c)]) for c in order) for x in want), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0
