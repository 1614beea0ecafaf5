"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tessera.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.8g}"
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, oracle, name):
    got = QUERIES[name](spark, DATA)
    want = oracle.execute(SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    names = [c[0] for c in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
