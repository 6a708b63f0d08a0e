import __spark_entry__ as entry
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["a2_user_experience", "j1_nearest_event", "w1_failure_streaks", "m7_expiry", "s23_sections", "s2_threads", "p6_found", "a13_memo_age", "s38_heading_sets", "v13_sidecars"])
def test_against_sql(spark, name):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(str(r[names.index(k)]) for k in df.columns) for r in cur.fetchall()))
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == want
