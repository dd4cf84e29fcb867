"""Every registered relational query against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from sparkloom.plans import library

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_equals_oracle(spark, duck, name):
    df = library.queries()[name](spark, DIR)
    rel = duck.sql(library.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in names]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want
