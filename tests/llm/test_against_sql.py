"""Queries of the subpackage that SQL can say, on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "st1_events"])
def test_against_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    cur = c.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted(tuple(str(r[names.index(k)]) for k in df.columns) for r in cur.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == want
