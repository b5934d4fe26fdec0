"""Every registered core plan against DuckDB on the smallest test data, over whole tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tessella.plans.catalogue import ORACLES, QUERIES

DATA = os.environ.get("TESSELLA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if v is None or isinstance(v, bool | str):
        return repr(v)
    if isinstance(v, int | float | decimal.Decimal):
        return repr(round(float(v), 5) + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted([plain(row[names.index(c)]) for c in cols] for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
