import random
from math import sqrt

import numpy as np

from quillspark.llm import blocks
from quillspark.llm.near_duplicates import DAY, best_match_clusters, groups, near_pairs, settle_events
from quillspark.llm.sketch import joint_jaccard, registers


def score(a, b, ta, tb):
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    return 0.7 * dot / sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) + 0.3 * max(0, 1 - abs(ta - tb) / DAY / 7)


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for g in range(30):
        base = {f"w{rng.randrange(900)}": rng.randrange(1, 4) for _ in range(60)}
        for k in range(4):
            t = dict(base)
            for _ in range(rng.randrange(0, 14)):
                t.pop(rng.choice(list(t)), None)
                t[f"w{rng.randrange(900)}"] = 1
            rows.append((f"m{g}-{k}", rng.randrange(-3 * DAY, 6 * DAY), t))
    rows += [("copy1", 0, {"a": 1, "b": 2}), ("copy2", DAY, {"a": 1, "b": 2}), ("late", 30 * DAY, {"a": 1, "b": 2}), ("none", None, {"a": 1}), ("empty", 0, {}), ("null", 0, None)]
    df = spark.createDataFrame(rows, "id string, t long, tokens map<string,int>")
    want = {(a[0], b[0]) if a[0] < b[0] else (b[0], a[0]) for i, a in enumerate(rows) for b in rows[:i] if a[1] is not None and b[1] is not None and a[2] and b[2] and score(a[2], b[2], a[1], b[1]) >= 0.8}
    pairs = near_pairs(df).cache()
    assert {(r.memo_a, r.memo_b) for r in pairs.collect()} == want and pairs.count() == len(want)
    g = {r["id"]: r for r in groups(df).collect()}
    assert g["copy2"].group_id == "copy1" and g["none"].n_links == 0 and len(g) == len(rows) and (g["copy1"].n_copies, g["late"].n_copies) in ((1, 0), (0, 0))
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {k: r.group_id for k, r in g.items()} == {k: root(k) for k in parent}
    assert near_pairs(df.filter("false")).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**62), 2**62, 400)
    b = np.concatenate([a[:300], rng.integers(-(2**62), 2**62, 100)])
    one = np.ones(400, dtype=int)
    r = registers([a, b, np.zeros(0, dtype=int), a[:40]], [one, one, np.zeros(0, dtype=int), np.arange(1, 41)], 512)
    heavy = registers([a[:40]], [np.arange(1, 41) * 2.0], 512)  # twice the weight each: a similarity of a half
    assert abs((heavy[0] == r[3]).mean() - 0.5) < 0.08 and (heavy[0] >= r[3]).all()
    est = joint_jaccard(r[:1], r[1:2], np.array([400.0]), np.array([400.0]))[0]
    assert abs(est - 0.6) < 0.08
    union = registers([np.union1d(a, b)], [np.ones(len(np.union1d(a, b)), dtype=int)], 512)
    assert (np.maximum(r[0], r[1]) == union[0]).all() and not r[2].any()


def test_incremental_clusters_against_a_fold(spark):
    rng = random.Random(8)
    ids = [f"m{k:02d}" for k in range(40)]
    rows = [(i, rng.randrange(30) if rng.random() < 0.9 else None) for i in ids]
    pairs = {}
    for _ in range(60):
        a, b = sorted(rng.sample(ids, 2))
        pairs[a, b] = rng.choice([0.8, 0.85, 0.9, 0.95])
    order = sorted(ids, key=lambda i: (dict(rows)[i] is not None, dict(rows)[i] or 0, i))
    cluster = {}
    for k, i in enumerate(order):
        best = [(-pairs[tuple(sorted((i, o)))], o) for o in order[:k] if tuple(sorted((i, o))) in pairs]
        cluster[i] = cluster[min(best)[1]] if best else i
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "memo_a string, memo_b string, score double")
    got = best_match_clusters(df, spark.createDataFrame(rows, "id string, t long")).collect()
    assert {r["id"]: r.cluster_id for r in got} == cluster
    assert all(r.n_members == list(cluster.values()).count(r.cluster_id) for r in got)


def test_skewed_counts_are_found(spark):
    # one word 10 times and 20 others each: cosine 0.83, yet a Jaccard similarity of 0.2 only
    rows = [(f"m{k}", 3600 * k, {"hot": 10} | {f"w{k}-{i}": 1 for i in range(20)}) for k in range(12)]
    rows += [("half", 0, {f"x{i}": 1 for i in range(40)}), ("whole", 0, {f"x{i}": 1 for i in range(78)})]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and score(a[2], b[2], a[1], b[1]) >= 0.8}
    got = near_pairs(spark.createDataFrame(rows, "id string, t long, tokens map<string,int>")).collect()
    assert len(want) == 67 and {(r.memo_a, r.memo_b) for r in got} == want and len(got) == 67


def test_lower_threshold_is_not_bound_by_time(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 7)  # several blocks a cell
    rng = random.Random(5)
    rows = []
    for g in range(20):
        base = {f"w{rng.randrange(900)}": rng.randrange(1, 4) for _ in range(40)}
        for k in range(5):
            t = dict(base)
            for _ in range(rng.randrange(0, 30)):
                t.pop(rng.choice(list(t)), None)
                t[f"w{rng.randrange(900)}"] = 1
            rows.append((f"m{g}-{k}", rng.choice([None, rng.randrange(-3 * DAY, 6 * DAY), rng.randrange(400 * DAY)]), t))
    rows += [("copy1", 0, {"a": 1}), ("copy2", 90 * DAY, {"a": 1}), ("copy3", None, {"a": 1}), ("empty", 0, {}), ("null", None, None)]

    def total(a, b):
        timeless = a[1] is None or b[1] is None
        return score(a[2], b[2], *((0, 9 * DAY) if timeless else (a[1], b[1])))

    want = {tuple(sorted((a[0], b[0]))): total(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[2] and b[2] and total(a, b) >= 0.55}
    got = near_pairs(spark.createDataFrame(rows, "id string, t long, tokens map<string,int>"), 0.55).collect()
    assert {(r.memo_a, r.memo_b) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.score - want[r.memo_a, r.memo_b]) < 1e-9 for r in got)
    assert ("copy1", "copy3") in want and any(s < 0.7 for s in want.values())


def test_groups_by_the_closest_neighbours(spark):
    # two texts of cosine 0.8 may be 0.3 x 7 days x ... apart: their spans overlap, yet only some of their members are near
    a, b = {f"w{i}": 1 for i in range(50)}, {f"w{i}": 1 for i in range(40)} | {f"v{i}": 1 for i in range(10)}
    hours = 3_600_000_000
    for shift, linked in ((2, True), (40, False)):
        rows = [("a1", 0, a), ("a2", 100 * hours, a), ("b1", (50 - 30 + shift) * hours, b)]
        near = [abs(x[1] - y[1]) / DAY for x in rows[:2] for y in rows[2:]]
        df = spark.createDataFrame(rows, "id string, t long, tokens map<string,int>")
        got = {r["id"]: r.group_id for r in groups(df).collect()}
        pairs = {(r.memo_a, r.memo_b) for r in near_pairs(df).collect()}
        assert (got["b1"] == "a1") == any(score(x[2], y[2], x[1], y[1]) >= 0.8 for x in rows[:2] for y in rows[2:]) == bool(pairs & {("a1", "b1"), ("a2", "b1")}), (near, linked)


def test_events_are_settled(spark):
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "e")], "id string, cluster_id string")
    rows = [("a", None, 2, 5, True), ("b", "evt-9", 1, 9, None), ("c", None, 1, None, True), ("d", None, 1, 1, True), ("e", "evt-e", 3, 1, True), ("f", None, 3, 2, False)]
    df = spark.createDataFrame(rows, "id string, event string, authority int, t long, flagged boolean")
    got = {r["id"]: (r.event if r.event in (None, "evt-9", "evt-e") else "made", r.canonical, r.seeded, r.demoted) for r in settle_events(clusters, df).collect()}
    assert got == {
        "a": ("made", False, True, True), "b": ("evt-9", True, False, False), "c": ("made", False, True, True), "d": (None, True, False, False),
        "e": ("evt-e", True, False, False), "f": ("evt-e", False, True, False),
    }


def test_scores_of_the_same_event_and_of_a_later_one(spark):
    # one event told by two sources scores far above 0.55; a follow-up a week later with the same frame stays below
    talk = {w: 1 for w in "decided move billing service cluster friday rollback owner latency budget".split()}
    same, later = talk | {"thread": 1}, {w: 1 for w in "decided cancel invoice tool quarter monday freeze owner latency cost".split()}
    rows = [("mail", 0, talk), ("slack", DAY, same), ("later", 8 * DAY, later)]
    got = {(r.memo_a, r.memo_b): round(r.score, 4) for r in near_pairs(spark.createDataFrame(rows, "id string, t long, tokens map<string,int>"), 0.55).collect()}
    assert set(got) == {("mail", "slack")} and abs(got["mail", "slack"] - score(talk, same, 0, DAY)) < 1e-4
