import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import moments, text
from quillspark.operators import asof, memory, runs, texts
from quillspark.plans.components import connected_components
from quillspark.sources import readers, sinks
from quillspark.sources.tables import hash_sample, latest_rows
from quillspark.streaming import streams


def test_nearest_join(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 1000), (3, "b", 100), (4, None, 5), (5, "a", None)], "id int, k string, at long")
    right = spark.createDataFrame([(10, "a", 90), (11, "a", 110), (12, "a", 700), (13, "c", 100)], "rid int, k string, at long")
    got = {r["id"]: (r.match_id, r.gap_us) for r in asof.nearest(left, right, "k", "id", "rid", 1000).collect()}
    assert got == {1: (10, 10), 2: (12, 300), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_failure_streaks_and_freshness(spark):
    t = lambda h: datetime(2026, 1, 1 + h // 24, h % 24)
    rows = [("s", f"r{i}", t(i), ok, e) for i, (ok, e) in enumerate([(True, None), (False, "x"), (False, "x"), (None, "x"), (False, "x"), (False, "y"), (True, None), (False, None)])]
    df = spark.createDataFrame(rows, "scheduler string, run_id string, at timestamp, ok boolean, error string")
    got = sorted((r.error, r.n_failures) for r in runs.streaks(df).collect())
    assert got == [("", 1), ("x", 3), ("y", 1)]
    assert runs.freshness(df, "scheduler").first().state == "FAILED"
    stuck = df.filter("run_id in ('r1', 'r2', 'r4')")
    assert runs.freshness(stuck, "scheduler").first().state == "STUCK"
    assert runs.streaks(df.filter("false")).count() == 0


def test_running_total_crosses_blocks(spark):
    rows = [("g", i, 2) for i in range(50)] + [(None, 3, 7)]
    df = spark.createDataFrame(rows, "g string, at long, n long")
    got = memory.running_total(df, "g", ["at"], "n", block=7).orderBy("g", "at").collect()
    assert [r.running for r in got] == [7] + [2 * (i + 1) for i in range(50)]


def test_sections_ignore_fences(spark):
    doc = "intro\n## A\n```\n## no\n```\nx\n## B \n"
    got = texts.sections(spark.createDataFrame([(1, doc), (2, None), (3, "")], "i int, t string"), "i", "t").orderBy("id", "section_no").collect()
    assert [(r.id, r.section_no, r.line_no, r.title, r.n_lines) for r in got] == [(1, 0, 1, None, 1), (1, 1, 2, "A", 5), (1, 2, 7, "B", 2), (3, 0, 1, None, 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("The Café, the naïve_x — a@b.org Rollback rollback",), (None,), ("",)], "t string")
    got = df.select(text.terms(F.col("t")).alias("a"), text.topic_keywords(F.col("t")).alias("b"), text.slug(F.col("t")).alias("c"), text.estimated_tokens(F.col("t")).alias("d")).collect()
    assert got[0].a == ["café", "naïve_x", "org", "rollback", "rollback"] and got[0].d == 12
    assert got[0].b[-1] == "rollback" and got[1].a == [] and got[1].c == "untitled" and got[2].d == 0


def test_times(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("null",), ("",), (None,), ("2026-01-01T02:00:00+02:00",)], "t string")
    assert [r.x for r in df.select(F.unix_micros(moments.tolerant(F.col("t"))).alias("x")).collect()] == [1767225600000000, None, None, None, 1767225600000000]
    day = spark.range(1).select(moments.whole_days(F.lit("2026-01-01 12:00:00").cast("timestamp"), F.lit("2026-01-03 11:00:00").cast("timestamp")).alias("d"), F.unix_micros(moments.stamp_of(F.lit("2026-04-15T102233Z.json"))).alias("s")).first()
    assert day.d == 1 and day.s == 1776248553000000


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(1, 1), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x int, y int"), "x", "y").collect()}
    assert got == {x: find(x) for x in parent}


def test_latest_rows_and_sample(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n")], "id string, m int, v string")
    assert sorted((r.id, r.v) for r in latest_rows(df, "id", "m").collect()) == [("a", "y"), ("b", "z")]
    assert hash_sample(spark.range(1000), F.col("id"), 100).count() <= 200


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text("---\nid: 'x'\ntags: [a]\nid: y\n---\n\nBody\n")
    (tmp_path / "m" / "b.md").write_text("no block")
    (tmp_path / "m" / "c.md").write_text("---\nopen")
    (tmp_path / "m" / ".hid").mkdir()
    (tmp_path / "m" / ".hid" / "d.md").write_text("hidden")
    got = {r["name"]: r for r in readers.front_matter(readers.whole_files(spark, str(tmp_path / "m"), ["md"])).collect()}
    assert got["a.md"].fields == {"id": "x", "tags": "[a]"} and got["a.md"].body == "Body\n"
    assert (got["b.md"].status, got["c.md"].status) == ("none", "open") and len(got) == 3
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "t.json").write_text(json.dumps({"channel": "C", "thread_ts": "1.5", "messages": [{"type": "message", "user": "U", "ts": "1.5", "text": "Hi\nyou"}]}))
    t = readers.slack_threads(spark, str(tmp_path / "s"))
    assert t.first().title == "Hi" and t.first().dedupe_key == "slack:C:1.5"
    assert t.select(readers.render_thread(F.col("messages")).alias("x")).first().x == "## 1970-01-01T00:00:01Z — user:U (ts:1.5)\n\nHi\nyou"
    (tmp_path / "e").mkdir()
    for day in ("2026-01-01", "2026-01-05"):
        (tmp_path / "e" / f"events-{day}.jsonl").write_text('{"ts": "x", "event": "q"}\n\n{broken\n{"ts": "y", "event": "q", "data": {"k": 1}}\n')
    assert readers.event_log(spark, str(tmp_path / "e"), "2026-01-01", "2026-01-02").count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "2026-01-01T000000Z.json").write_text('{"ok": true, "started_at": ""}')
    (tmp_path / "r" / "2026-01-02T000000Z.json").write_text("{nope")
    (tmp_path / "r" / "2026-01-03T000000Z.json").write_text("[1]")
    assert [r.status for r in readers.run_states(spark, str(tmp_path / "r")).orderBy("name").collect()] == ["ok", "corrupt", "other"]
    (tmp_path / "log.tsv").write_text("# head\n" + "\t".join("abcdefghijkl") + "\n" + "\t".join("abcdefghijklm") + "\nshort\trow\n")
    assert sorted(r.scope_source for r in readers.accuracy_log(spark, str(tmp_path / "log.tsv")).collect()) == ["m", "unknown"]
    with pytest.raises(ValueError):
        readers.folder_items(spark, "gmail", str(tmp_path))


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c"), (None, "d")], "dedupe_key string, content string")
    args = (str(tmp_path / "state"), str(tmp_path / "raw"), spark)
    assert sinks.harvest(items, *args, dry_run=True).count() == 2
    sinks.harvest(items, *args)
    assert sinks.harvest(items, *args).count() == 0 and spark.read.parquet(str(tmp_path / "raw")).count() == 2
    ev = spark.createDataFrame([(datetime(2026, 1, 1), "s", "q", 1.0, {"Query": "secret", "k": "1"}), (datetime(2026, 1, 1), "s", "q", 1.0, {"k": "x" * 5000})], "ts timestamp, session_id string, event string, duration_ms double, data map<string,string>")
    sinks.append_events(ev, str(tmp_path / "ev"))
    back = spark.read.json(str(tmp_path / "ev"))
    assert back.count() == 1 and back.select("data.*").columns == ["k"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("1")
    listed = sinks.manifest(spark, str(tmp_path / "f")).cache()
    assert sinks.verify_manifest(listed, listed).count() == 0
    assert sinks.verify_manifest(listed, listed.filter("false")).first().problem == "missing"


def test_stream_drops_second_deliveries(spark, tmp_path):
    rows = [(1, "c", datetime(2026, 1, 1)), (1, "c", datetime(2026, 1, 2)), (2, "c", datetime(2026, 1, 3))]
    spark.createDataFrame(rows, "msg_id long, channel string, ingested_at timestamp").coalesce(1).write.parquet(str(tmp_path / "slack_messages.parquet"))
    s = spark.readStream.schema("msg_id long, channel string, ingested_at timestamp").parquet(str(tmp_path / "slack_messages.parquet"))
    assert streams.run_to_end(streams.first_deliveries(s, "msg_id", "ingested_at")).count() == 2


def test_retrieval_prefers_newer_of_equal_rows(spark):
    rows = [("a", "rollback of the pilot", datetime(2025, 8, 1), None), ("b", "rollback of the pilot", datetime(2026, 4, 1), None), ("c", "other", datetime(2026, 4, 1), None), ("d", None, None, None)]
    df = spark.createDataFrame(rows, "id string, haystack string, at timestamp, canonical boolean")
    got = memory.retrieve(df, F.lit("what about the rollback"), F.lit("2026-05-01").cast("timestamp"), 3).collect()
    assert [r["id"] for r in got[:2]] == ["b", "c"] or got[0]["id"] == "b"


def test_event_windows_include_the_open_ones(spark, tmp_path):
    from quillspark.streaming.streams import st8_event_windows

    e = spark.createDataFrame([("2024-01-01 00:10:00", "view"), ("2024-01-01 00:50:00", "view"), ("2024-01-01 05:10:00", "view"), ("2024-01-01 05:20:00", "click")], "ts string, event_type string")
    e.selectExpr("cast(ts as timestamp) as ts", "event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    part = next((tmp_path / "events.parquet").glob("part-*"))
    (tmp_path / "in").mkdir()
    part.rename(tmp_path / "in" / "events.parquet")
    got = st8_event_windows(spark, str(tmp_path / "in")).collect()
    assert sorted((r.window_start // 3_600_000_000 % 24, r.event_type, r.n) for r in got) == [(0, "view", 2), (5, "click", 1), (5, "view", 1)]
