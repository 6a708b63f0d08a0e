from quillspark.llm.survivors import golden_records, judge_values, resolve_events, survivors

M = "event string, id string, source string, authority int, micros long, title string, summary string, tags array<string>, body string, n int"


def test_chains_circles_and_dead_ends(spark):
    rows = [("a", " EVT-1 ", None), *[(f"c{i}", None, f"c{i - 1}" if i else "a") for i in range(11)], ("x", "n/a", "y"), ("y", None, "x"), ("z", None, "gone"), ("s", None, "s"), ("w", "", None)]
    got = {r["id"]: r.event for r in resolve_events(spark.createDataFrame(rows, "id string, event_id string, superseded_by string")).collect()}
    assert got == {"a": "evt-1", **{f"c{i}": "evt-1" for i in range(11)}, "x": None, "y": None, "z": None, "s": None, "w": None}


def test_fields_survive_one_by_one(spark):
    rows = [
        ("e", "b", "s1", 1, 5, "TBD", None, [], None, 0),
        ("e", "a", "s1", 1, 5, "n/a", "sum", ["??"], "", 0),
        ("e", "c", "s2", 2, 9, "Title", "no", ["t"], "-", 0),
        ("e", "d", "s3", None, None, "Last", "no", ["u"], " ", 0),
        ("one", "x", "s1", 1, 1, "T", "S", ["t"], "B", 0),
        (None, "y", "s1", 1, 1, "T", "S", ["t"], "B", 0),
    ]
    df = spark.createDataFrame(rows, M)
    got = {(r.event, r.field): r.memo_id for r in survivors(df).collect()}
    assert got == {("e", "id"): "a", ("e", "title"): "c", ("e", "summary"): "a", ("e", "tags"): "c"}
    assert survivors(df.filter("false")).count() == 0


def test_truth_model_finds_the_bad_source(spark):
    rows = []
    for e in range(60):
        true = [f"t{e}", f"u{e}", f"w{e}"]
        for s in ("good1", "good2", "good3"):
            rows.append((f"e{e}", f"{s}-{e}", s, 1, 1, "T", "S", true, "B", 0))
        rows.append((f"e{e}", f"bad-{e}", "bad", 2, 1, "T", "S", [f"t{e}", f"lie{e}", f"fib{e}"], "B", 0))
    df = spark.createDataFrame(rows, M)
    values, quality = judge_values(df)
    q = {r.source: r for r in quality.collect()}
    assert q["good1"].specificity > 0.9 > q["bad"].specificity
    assert values.filter("value like 'lie%' and posterior > 0.5").count() == 0 and values.filter("value like 'u%' and posterior > 0.9").count() == 60
    rec = golden_records(df).filter("event = 'e3'").first()
    assert rec.tags == ["t3", "u3", "w3"] and rec.memo_id == "good1-3"


def test_agreement_counts_choices(spark):
    from quillspark.llm.survivors import agreement

    rows = []
    for k in range(30):  # two sources that say the same against one, most trusted, that is always alone
        rows += [(f"e{k}", f"a{k}", "good", 2, 1, "Plan", None, ["x"], "b"), (f"e{k}", f"b{k}", "also", 3, 1, "Plan", None, ["x"], "b"), (f"e{k}", f"c{k}", "odd", 1, 1, f"Odd {k}", None, ["x"], "b")]
    df = spark.createDataFrame(rows, "event string, id string, source string, authority int, micros long, title string, summary string, tags array<string>, body string")
    got = {r.field: r for r in agreement(df).collect()}
    assert (got["title"].n, got["title"].n_agree, got["title"].n_open) == (30, 0, 30)
    assert (got["body"].n, got["body"].n_agree, got["body"].n_open) == (30, 30, 0) and "summary" not in got
