import random

import numpy as np
import pytest

from quillspark.llm.containers import best_fit, document_items, fill_containers
from quillspark.llm.mixing import draw, flight, land, reached_shares
from quillspark.llm.splitting import pack, split_pieces, split_text
from quillspark.llm.tokens import count, token_count, token_starts

MD = "\n".join(["# Top", "", "Intro words here. More of them!", ""] + [f"## Part {k}\n\n- item one of {k}\n- item two, longer than one\n\nSome paragraph. It has sentences; two of them. Zoë’s café — ünïcode.\n\n```\n## no heading\n\ncode {k}\n```\n" for k in range(30)])


@pytest.mark.parametrize("text", [MD, "x" * 9000, "word " * 3000, "é😀" * 2000, "\n" * 5000, "a. b. " * 2000 + "y" * 4000])
@pytest.mark.parametrize("limit, overlap", [(64, 8), (200, 0), (7, 3)])
def test_pieces_cover_the_text(text, limit, overlap):
    out = split_text(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b, _ in out) == text
    for back, a, b, n in out:
        assert back <= a < b and n == count(text[back:b])
        assert n <= limit or b - a == 1
    assert not out[0][1] and out[0][0] == 0
    if overlap:
        assert sum(b < a for b, a, _, _ in out[1:]) >= 0.9 * (len(out) - 1) or limit < 10


def test_natural_boundaries():
    spans = pack(MD, lambda a, b: b - a, 400)
    assert all(MD[a:].startswith(("#", "-", "Some", "```")) for a, b in spans)
    assert not any("```" in MD[a:b] and MD[a:b].count("```") % 2 for a, b in spans)


def test_estimate_needs_no_tokenizer():
    assert split_text("a" * 2051, 512, 48, None) == [] and split_text("", 5, 1) == []
    out = split_text("a" * 2052, 512, 48, None)
    assert len(out) == 2 and all(n <= 512 for *_, n in out)
    with pytest.raises(ValueError):
        split_text("a", 4, 4)


def test_split_frame(spark):
    df = spark.createDataFrame([(1, MD, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x")], "doc_id long, text string, id string")
    got = split_pieces(df, "doc_id", "text", 64, 8)
    assert {r.doc_id for r in got.collect()} == {1} and got.columns[0] == "doc_id"
    assert [r.n for r in df.select(token_count(df.text).alias("n")).collect()] == [count(MD), count("short"), 0, 0]
    assert len(token_starts("Zoë’s café")) == count("Zoë’s café")


def test_best_fit_is_tight_and_keeps_conflicts_apart():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 101) for _ in range(600)]
    clusters = [rng.randrange(40) if rng.random() < 0.3 else 1000 + k for k in range(600)]
    sources = [rng.choice("abc") for _ in sizes]
    b = best_fit(sizes, sources, clusters, 100, {"a": {"b"}})
    for k in set(b):
        inside = [i for i in range(600) if b[i] == k]
        assert sum(sizes[i] for i in inside) <= 100 and len({clusters[i] for i in inside}) == len(inside)
        assert not {"a", "b"} <= {sources[i] for i in inside}
    free = best_fit(sizes, ["a"] * 600, range(600), 100)
    assert len(set(free)) <= 1.03 * sum(sizes) / 100 + 1
    assert best_fit([], [], [], 10) == []


def test_containers_frame(spark):
    long = "one two three four five six seven eight nine ten. " * 40
    rows = [(k, f"text number {k} " * (k % 17 + 1), " Doc" if k % 2 else None) for k in range(300)] + [(1000, long, "log"), (1001, "", "doc"), (1002, None, "doc"), (1003, "same same", "doc"), (1004, "Same, same!", "doc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = fill_containers(document_items(docs, 64), 64).collect()
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r["size"]
    assert all(v <= 64 for v in fill.values()) and all(fill[r.container_id] == r.filled for r in got)
    ids = {(r["item"], r.part) for r in got}
    assert len(ids) == len(got) and {i for i, _ in ids} == {d for d, t, _ in rows if t} and {p for i, p in ids if i == 1000} == set(range(1, len([1 for i, _ in ids if i == 1000]) + 1))
    home = {r["item"]: r.container_id for r in got}
    assert home[1003] != home[1004]
    assert np.mean(list(fill.values())) > 0.93 * 64
    assert fill_containers(document_items(docs.filter("false"), 64), 64).count() == 0


def test_flight_keeps_totals_and_decides_nearly_all():
    rng = np.random.default_rng(3)
    for n, p in ((1, 0.3), (2, 0.5), (500, 0.02), (500, 0.7)):
        size, pi = rng.integers(1, 2000, n), np.full(n, p)
        out = flight(pi, size, rng)
        left = ((out > 0) & (out < 1)).sum()
        assert left <= 2 and abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-4
    mean = np.mean([flight(np.full(30, 0.2), np.arange(1, 31), np.random.default_rng(k)) for k in range(600)], axis=0)
    assert np.abs(mean - 0.2).max() < 0.08
    same = flight(np.full(10, 0.5), np.full(10, 7), rng)
    assert ((same == 0) | (same == 1)).all()


def test_mixture(spark):
    rng = random.Random(9)
    rows = [(k, "big" if k % 3 else "mid", rng.randrange(5, 400)) for k in range(3000)] + [(9000 + k, "small", 50) for k in range(4)] + [(9100, "none", 5), (9101, "big", 0), (9102, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = spark.createDataFrame([("big", 0.6, 2), ("mid", 0.35, 1), ("small", 0.04, 3), ("absent", 0.01, 9)], "source string, target_share double, max_repeats int")
    got = draw(docs, targets, 20000)
    total = got.selectExpr("sum(size * copies) as t").first().t
    assert 0.9 * 20000 <= total <= 20000
    assert {r.copies for r in got.filter("source = 'small'").collect()} == {3}
    assert got.filter("copies > 2 and source = 'big'").count() == 0 and got.filter("source = 'none' or size = 0").count() == 0
    s = {r.source: r for r in reached_shares(got, targets).collect()}
    assert abs(s["big"].mixture_tokens - 12000) < 500 and s["absent"].mixture_tokens == 0 and s["small"].mixture_tokens == 600
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, draw(docs, targets, 20000).collect()))
    assert draw(docs.filter("false"), targets, 20000).count() == 0


def test_landing_stays_within_room():
    import pandas as pd

    u = pd.DataFrame({"source": ["a", "a", "b"], "doc_id": [1, 2, 3], "size": [100, 60, 80], "pi": [0.6, 0.6, 0.9]})
    got = land(u, 150.0).set_index("doc_id")["pi"]
    assert (got * u.set_index("doc_id")["size"]).sum() <= 150


def test_shares_can_be_kept(spark):
    from quillspark.llm.mixing import plan_quotas

    docs = spark.createDataFrame([(k, "big" if k < 900 else "small", 10) for k in range(910)], "doc_id long, source string, size long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    short = {r.source: r.quota for r in plan_quotas(docs, targets, 2000).collect()}
    kept = {r.source: r.quota for r in plan_quotas(docs, targets, 2000, keep_shares=True).collect()}
    assert (short["big"], short["small"]) == (1000.0, 200.0) and (kept["big"], kept["small"]) == (200.0, 200.0)
