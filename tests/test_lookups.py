import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import markup
from quillspark.operators import lookups

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, project_id string, kind string, created_at timestamp, stem string",
    "memos": "id string, source_uri string, source_kind string, created_at string, expires_at string, kind string, tags array<string>, title string, summary string, event_id string, is_canonical_for_event boolean, superseded_by string, expiry_locked boolean, provenance string, body string, body_tokens map<string,int>, modified_at timestamp, source string",
    "raw_items": "raw_id string, source_kind string, path string, extension string, suggested_kind string, dedupe_key string, content string, modified_at timestamp, folder string",
    "harvest_items": "ref_no bigint, batch_no int, source_name string, id string, title string, created_at string, suggested_kind string, meta map<string,string>, content string, arrived_at timestamp, key string",
    "harvest_seen": "source_name string, dedupe_key string, memory_path string, seen_at timestamp",
    "harvest_runs": "run_id string, started_at string, ended_at string, ok boolean, scheduler string, phase string, error string, cutoff string, sources map<string, struct<new: int, errors: array<string>>>, modified_at timestamp",
    "people": "user_id string, full_name string, handle string, team string, tz string",
    "slack_messages": "msg_id bigint, channel string, thread_ts string, user_id string, type string, ts string, text string, user_tz string, ingested_at timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """Tables without rows, and tables of rows that hold nothing, each row twice; some have a column of a clashing name more."""
    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    for name, schema in TABLES.items():
        df = spark.createDataFrame([], schema)
        df.write.parquet(f"{empty}/{name}.parquet")
        spark.createDataFrame([(None,) * len(df.columns)] * 2, schema).write.parquet(f"{nulls}/{name}.parquet")
    return str(empty), str(nulls)


@pytest.mark.parametrize("name", sorted(lookups.QUERIES))
def test_empty_tables_and_rows_of_nulls(spark, bare, name):
    for folder in bare:
        df = entry.queries()[name](spark, folder)
        assert all(len(r) == len(df.columns) for r in df.collect())


def test_every_lookup_has_its_sql():
    assert set(lookups.QUERIES) == set(lookups.ORACLES)


@pytest.mark.parametrize("text, want", [("true", True), (" YES ", True), ("1", False), ("truely", False), ("", False), (None, False)])
def test_strict_flags(spark, text, want):
    assert one(spark, text, markup.strictly_true) is want


@pytest.mark.parametrize(
    "uri, want",
    [("art://a-b_1", None), (None, "missing"), ("  ", "missing"), ("mem://a", "scheme"), ("art://", "empty"), ("art://" + "a" * 128, None), ("art://" + "a" * 129, "long"), ("art://a b", "shape"), ("art://é", "shape"), ("art://a\n", "shape")],
)
def test_reference_errors(spark, uri, want):
    assert one(spark, uri, markup.reference_error) == want


@pytest.mark.parametrize("text, want", [("12", "integer"), ("-0.5e3", "number"), ("012", "text"), ("true", "boolean"), ("null", "null"), ("", "missing"), (None, "missing"), ("2026-01-01", "text")])
def test_literals(spark, text, want):
    assert one(spark, text, markup.literal_type) == want


@pytest.mark.parametrize("word, want", [("high", True), ("Medium ", True), ("low", False), ("sure", False), (None, False)])
def test_confidence(spark, word, want):
    assert one(spark, word, lambda c: lookups.meets(c, "medium")) is want


def test_globs():
    hit = lambda g, p: re.search(markup.glob_pattern(g), p) is not None
    assert hit("raw/*/*.md", "raw/a/b.md") and not hit("raw/*/*.md", "raw/a/c/b.md")
    assert hit("raw/**/b.md", "raw/b.md") and hit("raw/**/b.md", "raw/a/c/b.md") and not hit("raw/**/b.md", "raw/a/xb.md")
    assert hit("a?c.md", "abc.md") and not hit("a?c.md", "a/c.md") and not hit("a.md", "abmd")


def test_first_place_and_sidecars(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("r1", "slack", "raw/slack/x.md", None, None, "slack:1", None, None, None), ("r2", "note", "raw/note/y.md", None, None, "note:2", None, None, None)], TABLES["raw_items"]).write.parquet(f"{d}/raw_items.parquet")
    spark.createDataFrame([("slack", "slack:1", "memory/slack/x.md", None), ("note", "note:2", "memory/other/y.md", None), ("note", "note:3", None, None)], TABLES["harvest_seen"]).write.parquet(f"{d}/harvest_seen.parquet")
    spark.createDataFrame([(1, 1, "slack", "1", None, None, None, None, None, None, None), (2, 1, "slack", "9", None, None, None, None, None, None, None)], TABLES["harvest_items"]).write.parquet(f"{d}/harvest_items.parquet")
    assert sorted(map(tuple, lookups.pr26_first_place(spark, d).collect())) == [("accepted", 1, 0), ("archive", 2, 2), ("arriving", 1, 0)]
    assert sorted(map(tuple, lookups.v13_sidecars(spark, d).collect())) == [("note", "elsewhere", 1), ("slack", "matched", 1)]


def test_pinned_topics_and_snapshots(spark, tmp_path):
    from quillspark.sources import readers

    (tmp_path / "topics.txt").write_text("# pinned\n\n  alpha \nbeta\nalpha\n", encoding="utf-8")
    assert sorted(r[0] for r in readers.pinned_topics(spark, str(tmp_path / "topics.txt")).collect()) == ["alpha", "beta"]
    folder = tmp_path / "snapshots"
    folder.mkdir()
    (folder / "b.json").write_text('{"generated_at": "2026-02-01", "schema_version": 1}\n', encoding="utf-8")
    (folder / "a.json").write_text('{"generated_at": "2026-03-01", "schema_version": 2}\n{broken\n', encoding="utf-8")
    assert [(r.generated_at, r.known) for r in readers.snapshots(spark, str(folder)).collect()] == [("2026-02-01", True), ("2026-03-01", False)]


def test_processed_markers(spark, tmp_path):
    from quillspark.sources import sinks

    keys = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "key string, n int")
    path = str(tmp_path / "done")
    assert sinks.unprocessed(keys, path).count() == 4
    sinks.mark_processed(keys.filter("key = 'b' or key is null"), path, F.lit("2026-01-01").cast("timestamp"))
    sinks.mark_processed(keys.filter("key = 'b'"), path, F.lit("2026-01-02").cast("timestamp"))
    assert sorted(r.n for r in sinks.unprocessed(keys, path).collect()) == [1, 4]
