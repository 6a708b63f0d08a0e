from zlib import crc32

import numpy as np
import pytest

from quillspark.llm.boosting import BoostedTrees
from quillspark.llm.transcripts import classify_tokens, clean_words, features, learn, parse, speaker_name, learn_fillers, speaker_turns, train, training_sample, turns

EN = frozenset(["um", "uh", "mhm", "er"])


@pytest.mark.parametrize("label, want", [("Doe, Ann", "ann"), ("ANN DOE", "ann"), ("Ann D.", "ann"), ("Ann Doe [Host]", "ann"), ("Ann (guest)", "ann"), ("Ann Doe / sales", "ann"), ("SPEAKER_05", "speaker 5"), ("Speaker 02", "speaker 2"), ("de la Cruz, Zoë", "zoë"), ("", "")])
def test_names(label, want):
    assert speaker_name(label) == want


def test_fillers_and_remarks():
    assert clean_words("Um, we [laughs] er... met (applause) at 5 -- ♪ music ♪ mhm— *sighs* ((coughs)) today (inaudible 00:12)", EN) == ["we", "met", "at", "5", "--", "today"]
    assert clean_words("call (030) 555 now", EN) == ["call", "(030)", "555", "now"]


def sample():
    out = []
    names = [("Ann Doe", "Bob Roe"), ("Eva Poe", "Max Low"), ("Ida Fox", "Leo Ray")]
    talk = ["We should ship the build on Monday. Decision: keep the old one.", "um... The vendor was late. Action: call them today.", "Risk: the plan may slip uh... by a week.", "uh... I agree with the plan and the date."]
    for k in range(60):
        a, b = names[k % 3]
        cues = []
        for i in range(8):
            who = (a if (i + k) % 3 else b) if i % 2 else b
            cues.append(f"00:00:{i:02d}.000 --> 00:00:{i + 1:02d}.000\n<v {who if i % 3 else who.upper()}>{talk[(i + k) % 4]}</v>\n")
        out.append("```\nWEBVTT\n\n" + "\n".join(cues) + "```\n")
    return out


def run(model, text):
    t = parse(text)
    return turns(t, model.trees.probability(features(t, model.odds)) >= 0.5, model.fillers[t.language])


@pytest.fixture(scope="module")
def model(spark):
    fillers = learn_fillers(spark.createDataFrame([(t,) for t in sample()] + [(None,), ("",)], "content string"), "content")
    return train(sample(), fillers)


def test_models_learn(model):
    assert {"um", "uh"} & model.fillers["en"] and "plan" not in model.fillers["en"]
    x = np.random.default_rng(0).random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((BoostedTrees().fit(x, y).probability(x) > 0.5) == y).mean() > 0.95


def test_layouts(model):
    vtt = "WEBVTT\n\n00:00:05.000 --> 00:00:06.000\n<v Bob Roe>Second here.</v>\n\n00:00:01.000 --> 00:00:02.000\n<v ANN DOE>First words\n\n00:00:02.000 --> 00:00:03.000\n<v Doe, Ann>go on.\n\n00:00:03.000 --> 00:00:04.000\n<v Bob Roe>Um.\n"
    assert [r[1:3] for r in run(model, vtt)] == [("ann", 4), ("bob", 2)]
    srt = "1\n00:00:01,000 --> 00:00:02,000\nAnn Doe: We met and\n\n2\n00:00:02,000 --> 00:00:03,000\nthen left. Decision: none.\n\n3\n00:00:03,000 --> 00:00:04,000\nBob Roe: Fine.\n"
    assert [r[1:3] for r in run(model, srt)] == [("ann", 7), ("bob", 1)]
    plain = "Weekly sync — Plan\n2026-01-01 10:00 UTC\nAttendees: Ann Doe, Bob Roe (sales)\n\n[Recording started]\n\nAnn Doe: Hello there.\nmore words here.\nBOB: Yes we do.\n\nAnn: [Pause]\nBob R.: And more.\n"
    assert [r[1:3] for r in run(model, plain)] == [("ann", 5), ("bob", 5)]
    lines = "Sync — Plan\n2026-01-01 10:00 UTC\n\nAnn Doe\n00:00:01\nHello there.\n\nBob Roe\n00:00:09\nHi.\n"
    assert [r[1:3] for r in run(model, lines)] == [("ann", 2), ("bob", 1)]
    heads = "Sync — Plan\n2026-01-01 10:00 UTC\n\nAnn Doe  00:01\nHello there.\n\nSPEAKER_02  00:09\nHi.\n"
    assert [r[1:3] for r in run(model, heads)] == [("ann", 2), ("speaker 2", 1)]
    dashed = "(00:00:01) Ann Doe - Hello there.\n(00:00:09) Bob - Hi you.\n"
    assert [r[1:3] for r in run(model, dashed)] == [("ann", 2), ("bob", 2)]


def test_frame(spark, model):
    df = spark.createDataFrame([("a", sample()[0], 1), ("b", None, 2), ("c", "", 3), ("d", "um", 4)], "raw_id string, content string, turn_no int")
    got = speaker_turns(df, "raw_id", "content", model)
    rows = got.collect()
    assert {r.raw_id for r in rows} >= {"a"} and "b" not in {r.raw_id for r in rows}
    no = [r.turn_no for r in rows if r.raw_id == "a"]
    assert sorted(no) == list(range(1, len(no) + 1))
    assert speaker_turns(df.filter("false"), "raw_id", "content", model).count() == 0


def test_token_classifier():
    rng = np.random.default_rng(3)
    fillers = [("en", f"um{k}", 100, int(rng.integers(35, 60)), 40, int(rng.integers(10, 30))) for k in range(12)]
    words = [("en", f"word{k}", 1000, int(rng.integers(5, 40)), int(rng.integers(0, 90)), 0) for k in range(40)]
    # the same share set off: one token opens segments and stands alone, the other doesn't
    got = classify_tokens([*fillers, *words, ("en", "hm", 100, 20, 45, 25), ("en", "shipping", 100, 9, 1, 0)])["en"]
    assert {w for _, w, *_ in fillers} <= got and not {w for _, w, *_ in words} & got and "hm" in got and "shipping" not in got
    assert classify_tokens([])["de"] == frozenset()


def test_sample_counts_copies_once(spark):
    rows = [("same text " * 5,)] * 300 + [(f"text {k}",) for k in range(20)]
    got = training_sample(spark.createDataFrame(rows, "content string"), "content", 60)
    assert len(got) == len(set(got)) == 21


def test_all_transcripts_are_learned_from(spark):
    # each name stands in one text of 1,600, among them those that a sample of 1,500 leaves out: all must be known, and a name
    # that no certain label has is still a name
    a, b = "abcdefghijklmnopqrstuvwxyz"[:20], "aeiou"
    names = [f"{x.upper()}{y}{z}{w}n" for x in a for y in b for z in a[:16] for w in b[:1]]
    texts = []
    for k, name in enumerate(names):  # words in speech differ from labels in nothing but where else they stand
        said = ["We should ship the build. Decision: Keep the old one.", "The vendor was late. Action: Call them today."]
        cues = [f"00:00:00.000 --> 00:00:00.000\n<v {name if i % 2 else names[k - 1]}>{said[i % 2]}</v>\n" for i in range(6)]
        texts.append(("WEBVTT\n\n" + "\n".join(cues),))
    df = spark.createDataFrame(texts, "content string")
    assert df.distinct().count() == 1600
    model = learn(df.unionAll(df.limit(40)), "content")
    bucket = lambda x: crc32(x.encode()) % len(model.odds)
    assert min(model.odds[bucket(x.lower())] for x in names) > 0 > model.odds[bucket("decision")]
    plain = "Sync\n2026-01-01 10:00 UTC\n\nXaveria: Hello there.\nDecision: We go.\nYolanda: Yes we do.\nXaveria: And more.\n"
    assert [r[1] for r in run(model, plain)] == ["xaveria", "yolanda", "xaveria"]


def test_learning_from_a_table_is_learning_from_its_texts(spark, model):
    df = spark.createDataFrame([(t,) for t in sample()] + [(None,), ("",)], "content string")
    got = learn(df, "content")
    want = train(sorted(set(sample())), got.fillers)
    assert np.array_equal(got.odds, want.odds)
    x = features(parse(sample()[0]), got.odds)
    assert np.allclose(got.trees.probability(x), want.trees.probability(x))
    assert learn(df.filter("content is null"), "content").trees.probability(np.zeros((1, 12))).shape == (1,)
