"""Every query of the core that has SQL, against it, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from wattloom.plans import core, problems, problems_sql

SQL = core.oracle_sql() | problems_sql.oracle_sql()
QUERIES = core.queries() | problems.queries()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    r = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    mine = sorted(tuple(plain(x[c]) for c in sorted(df.columns)) for x in df.collect())
    assert mine == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_every_query_is_registered():
    assert set(SQL) <= set(QUERIES)
    assert {f"p{n}_found" for n in (1, 4, 5, 6, 7)} <= set(QUERIES)
