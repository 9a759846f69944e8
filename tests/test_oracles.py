"""Every query with SQL beside it returns what DuckDB returns for that SQL; every other one runs."""

import glob
import math
import os

import duckdb
import pytest

from corvine.plans import catalog
from corvine.plans.load import load_all

load_all()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if v is None:
        return "\0null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in catalog.SQL:
        return
    r = duck.execute(catalog.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, r.fetchall())
    assert len(got) == len(want)
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
