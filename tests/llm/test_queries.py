"""Registered queries against their oracles on the smallest test data, over whole tables."""

import os

import duckdb
import pytest

from tessella.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TESSELLA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert sorted(str([x[c] for c in cols]) for x in df.collect()) == sorted(str([row[names.index(c)] for c in cols]) for row in r.fetchall())
