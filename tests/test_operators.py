"""Operators against brute force and defined edge cases."""

import random
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markup
from quillspark.functions.percentiles import exact_percentiles
from quillspark.operators import asof, islands, texts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_percentiles_against_numpy(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [("a", rng.choice([rng.random() * 100, 5.0, 5.0])) for _ in range(3000)] + [("b", 1.0), ("b", 2.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}, ["g"]).collect()}
    for g in ("a", "b"):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g].n == len(v) and np.allclose([got[g].p50, got[g].p95, got[g].top], np.percentile(v, [50, 95, 100]))
    assert "c" not in got and exact_percentiles(df.filter("false"), "v", {"p": 0.5}).count() == 0
    assert quantiles([1, 2, 3], n=2) == [2]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_runs_across_blocks(spark, block):
    rng = random.Random(block)
    rows = [(g, k, rng.choice("xy")) for g in ("g", "h", None) for k in sorted(rng.sample(range(60), 30))]
    df = spark.createDataFrame(rows, "g string, at long, e string")
    got = {(r.g, r["at"]): r.run_no for r in islands.number_runs(df, "g", ["at"], ["e"], lambda a, b: a["e"] != b["e"], block).collect()}
    want, last = {}, {}
    for g, k, e in rows:
        n, was = last.get(g, (0, None))
        last[g] = (n + (e != was), e)
        want[g, k] = last[g][0]
    assert got == want


def test_nearest_against_brute_force(spark):
    rng = random.Random(9)
    left = [(i, rng.choice("ab"), rng.randrange(5000)) for i in range(120)]
    right = [(1000 + i, rng.choice("abc"), rng.randrange(5000)) for i in range(150)]
    want = {}
    for i, k, t in left:
        c = [(abs(t - u), t // 700 - u // 700, j) for j, q, u in right if q == k and t // 700 - u // 700 in (0, 1)]
        want[i] = (min(c)[2], min(c)[0]) if c else (None, None)
    got = asof.nearest(spark.createDataFrame(left, "id int, k string, at long"), spark.createDataFrame(right, "rid int, k string, at long"), "k", "id", "rid", 700).collect()
    assert {r["id"]: (r.match_id, r.gap_us) for r in got} == want and len(got) == len(left)


def test_fences_end_at_their_own_kind(spark):
    doc = "## A\n```\n~~~\n## no\n```\n## B\n~~~\n```\n## no\n"
    got = texts.sections(spark.createDataFrame([(1, doc), (2, "x" * 5000 + "\n## " + "y" * 3000)], "i int, t string"), "i", "t").collect()
    assert [(r.section_no, r.line_no, r.title, r.n_lines) for r in got if r["id"] == 1] == [(1, 1, "A", 5), (2, 6, "B", 5)]
    assert max(len(r.title or "") for r in got) == 3000


def test_normalised(spark):
    assert one(spark, markup.normalised, "Leonor Mendonça — ﬁne½ Straße!") == "leonor mendonca fine12 strae"
    assert one(spark, markup.normalised, None) is None and one(spark, markup.normalised, " A_b ") == "a b"


def test_front_matter(spark):
    t = '---\nid: "m 1"\ntags: [a, "b c"]\nrefs:\n- x\n- \'y\'\nid: m2\nby:\n  session: abc\n  at: 2026\n---\n\nbody\n'
    assert one(spark, markup.header_fields, t)["id"] == "m 1" and one(spark, markup.header_fields, "no") is None
    assert one(spark, lambda c: markup.header_list(c, "tags"), t) == ["a", "b c"] and one(spark, lambda c: markup.header_list(c, "refs"), t) == ["x", "y"]
    assert one(spark, lambda c: markup.header_list(c, "none"), t) is None and one(spark, lambda c: markup.header_map(c, "by"), t) == {"session": "abc", "at": "2026"}
    got = one(spark, lambda c: markup.updated(markup.header_fields(c), {"id": "new", "refs": None, "more": "1"}), t)
    assert got["id"] == "new" and "refs" not in got and got["more"] == "1" and "tags" in got


def test_produced_by(spark):
    good = 'x <!-- produced_by: session=0a1b2c3d, query="who, now", at=2026-05-07T10:00:00Z, sources=[kb#A b, art://art-12, https://x.y/z] --> y'
    p = one(spark, markup.produced_by, good)
    assert p.session == "0a1b2c3d" and p.sources == ["kb#A b", "art://art-12", "https://x.y/z"] and p.at == "2026-05-07T10:00:00Z"
    assert one(spark, markup.produced_by, "none") is None
    bad = '<!-- produced_by: session=XYZ, query="", at=May, sources=[kb# a] -->'
    assert one(spark, lambda c: markup.produced_by_errors(markup.produced_by(c)), bad) == ["session", "query", "at", "source"]
    assert one(spark, lambda c: markup.produced_by_errors(markup.produced_by(c)), bad.replace("kb# a", "")) == ["session", "query", "at", "sources"]
    assert [one(spark, markup.bare_reference, x) for x in ("art://art-1f", "art://1f", "mem://1f", None)] == ["1f", "1f", None, None]


def test_flags_fences_and_diffs(spark):
    assert [one(spark, markup.flag_state, x) for x in (None, " 'TRUE' ", "false", "1", "")] == ["absent", "true", "false", "malformed", "malformed"]
    assert one(spark, markup.without_fences, "```yaml\na: 1\n```\n") == "a: 1" and one(spark, markup.fenced_blocks, "a\n```\nx\n```\n~~~\ny\n~~~\n") == ["x\n", "y\n"]
    assert one(spark, markup.added_lines, "+a\n\n+ b") == "a\n\n b" and one(spark, markup.added_lines, "+a\n b") is None
    assert one(spark, markup.bad_diff_lines, "+a\nb\n\n-c") == [2, 4]


def test_keywords_and_topics(spark):
    assert one(spark, lambda c: markup.clean_keywords(markup.split_keywords(c)), " A, ,a,b,c,d,e," + "x" * 50) == ["a", "a", "b", "c", "d"]
    first = lambda c: markup.first_topic(c, ["zeta plan", "C++", "plan"])
    assert [one(spark, first, x) for x in ("The Plan of zeta", "a ZETA plan", "planet", None)] == ["plan", "zeta plan", None, None]
    reason = spark.sql("select 0 as h, 'x' as t union all select 2, 'x' union all select 2, null").select(markup.live_reason(F.col("h"), F.col("t")).alias("r"))
    assert [r.r for r in reason.collect()] == ["zero_hit", "topic_pinned", None]


def test_scope_mentions(spark):
    m = spark.createDataFrame([("m1", ["data platform"], ""), ("m2", [], "the hr note on data"), ("m3", None, "of a"), ("m4", ["x"], "")], "id string, tags array<string>, said string")
    s = spark.createDataFrame([("platform team",), ("hr",), ("of",)], "scope string")
    assert sorted(map(tuple, texts.scope_mentions(m, s).collect())) == [("m1", "platform team"), ("m2", "hr")]
