"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from threadloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    rel = con.execute(catalog.ORACLE_SQL[name])
    columns = sorted(d[0] for d in rel.description)
    at = [[d[0] for d in rel.description].index(c) for c in columns]
    want = sorted(tuple(cell(r[k]) for k in at) for r in rel.fetchall())
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    got = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
