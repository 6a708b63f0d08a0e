import pytest
from pyspark.sql import functions as F

from quillspark.llm.mail import Dictionary, SEED_CLOSINGS, ancestor_lines, learn_closings, new_lines, shape, thread_of, written_lines

D = Dictionary([shape(x) for x in SEED_CLOSINGS])


def kept(text):
    return new_lines(text, D)


@pytest.mark.parametrize(
    "text, want",
    [
        ("From: A B <a@x.test>\nDate: x\nTo: c\nSubject: s\n\nHi C,\n\nNew text here.\n\nBest,\nA\nBoss\n+1 2 3\n", [6, 8]),
        ("Hi,\n\nNew.\n\nOn 3 Jan 2026, at 05:24, b@x.test\nwrote:\n\n> old\n> > older\n", [1, 3]),
        ("Hi,\n\n>= 5 ms is what we see.\n\nOn 2026-01-02 03:04, B wrote:\n    old text\n    more\n\nAnswer below.\n", [1, 3, 9]),
        ("Answer one.\n> quoted\nAnswer two.\n| also quoted\nAnswer three.\n", [1, 3, 5]),
        ("New.\n\n-----Original Message-----\nFrom: X Y <x@y.test>\nSent: today\nTo: a\nSubject: b\n\nOld unmarked text.\n", [1]),
        ("To: whoever keeps this. It stays.\n\nOn Monday Eva wrote that it works.\nBest regards to all in town, and one more thing.\n", [1, 3, 4]),
        ("New.\n\nSincerely,\nEva\n\nPS: One more\nthing.\n", [1, 6, 7]),
        ("New.\n\n-- \nEva Doe\nBoss | Firm\n", [1]),
        ("New.\n\nSent from my phone\n", [1]),
        ("> only quoted\n> text", []),
        ("From: Eva Doe <e@x.test>\nTo: b\n\nHi,\n\nNew text.\nEva\n", [4, 6]),
        ("", []),
        ("\n\n\n", []),
        ("New one.\r\n\r\nThanks,\r\nEva\r\n", [1]),
        ("Begin forwarded message:\nFrom: X Y <x@y.test>\nSent: today\nTo: a\nSubject: b\n\nOld.\n", []),
    ],
)
def test_lines(text, want):
    assert kept(text) == want


def test_dictionary_needs_exact_words():
    assert D.repeats(shape("Sent from my phone"))
    assert not D.repeats("Please send the phone to my office environment before the printing starts today")
    assert not Dictionary([]).repeats("anything at all")


def test_closings_are_learned_over_all_mails(spark):
    foot = "Acme Holding keeps all mail for seven years by law."
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + (i + k) % 26)}x" for k in range(12)) + f".\n\n{foot}\n") for i in range(40)]
    df = spark.createDataFrame(rows, "raw_id int, content string")
    learned = learn_closings(df, "content")
    assert any("keeps all mail" in x for x in learned)
    got = written_lines(df, "raw_id", "content", learned)
    assert got.count() == 40 and got.filter("line_no = 1").count() == 40


def test_frames(spark):
    df = spark.createDataFrame([("a", "New.", "x"), ("a", "New.", "x"), ("b", None, "y"), ("c", "x " * 200000, "z")], "raw_id string, content string, text string")
    got = written_lines(df, "raw_id", "content", [])
    assert got.count() == 3 and got.columns == ["raw_id", "line_no", "line"]
    assert written_lines(df.filter(F.lit(False)), "raw_id", "content", []).count() == 0


def test_thread_ancestors(spark):
    from datetime import datetime

    old = "The rollout of the northern cluster starts on Monday and ends when the last shard has moved."
    mail = lambda subject, body: f"From: A B <a@x.test>\nTo: c\nSubject: {subject}\n\n{body}\n"
    rows = [
        ("m1", mail("Plan", f"Hi,\n\n{old}"), datetime(2026, 1, 1)),
        ("m2", mail("RE: Plan", f"I agree with this.\n\n{old}\n\nLet us begin with the small one of the two clusters then."), datetime(2026, 1, 2)),
        ("m3", mail("Re: AW: plan", f"{old[:60]} whenever the second shard of the eastern cluster is free again."), datetime(2026, 1, 3)),
        ("m4", mail("Other", old), datetime(2026, 1, 4)),
        ("m5", mail("Plan", f"Hi,\n\n{old}"), datetime(2026, 1, 5)),  # m1 delivered again
        ("m6", mail("Re: Plan", old), None),
    ]
    df = spark.createDataFrame(rows + [rows[1]], "raw_id string, content string, at timestamp")
    plain = {(r.raw_id, r.line_no) for r in written_lines(df, "raw_id", "content", []).collect()}
    new = {(r.raw_id, r.line_no) for r in written_lines(df, "raw_id", "content", [], "at").collect()}
    assert plain - new == {("m2", 7)}


def test_no_length_is_too_long():
    long_name = "Eva " + "Verylongname" * 30
    assert kept(f"New.\n\nOn 3 Jan 2026, at 05:24, {long_name} wrote:\n\n> old\n") == [1]
    early = "An early line of the quotation that the sender repeats word for word below it."
    quoted = "\n".join("> " + x for x in [early] + [f"filler {i} " + "abcdefghij"[i % 10] * 60 for i in range(900)])
    assert kept(f"New.\n\nOn 3 Jan 2026, at 05:24, B wrote:\n{quoted}\n\n{early}\n") == [1]


def test_long_closings_are_learned(spark):
    foot = " ".join(f"clause{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)) + "."
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + (i + k) % 26)}x" for k in range(12)) + f".\n\n{foot}\n") for i in range(40)]
    df = spark.createDataFrame(rows, "raw_id int, content string")
    learned = learn_closings(df, "content")
    assert foot in learned and written_lines(df, "raw_id", "content", learned).count() == 40


def test_every_earlier_unit_of_a_thread_is_an_ancestor(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(8)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "po", "re", "su", "ti") for b in ("ran", "sul", "tim", "vox", "wet", "xal")]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 25, 40, 41)]
    mails = []
    for k in range(240):  # edits pile up: a unit often repeats another than the first that shares a triple with it
        words = list(rng.choice(base[-30:]))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        base.append(words)
        body = " ".join(words) if k % 3 else f"{' '.join(words)}\n\n{' '.join(rng.choice(base))}"
        mails.append((f"m{k if k % 7 else k // 2}", f"From: A B <a@x.test>\nTo: c\nSubject: {rng.choice(['Plan', 'Other'])}\n\n{body}\n", datetime(2026, 1, 1) + timedelta(hours=rng.randrange(100))))
    mails += rng.sample(mails, 20) + [(f"again{k}", c, at + timedelta(hours=9)) for k, (_, c, at) in enumerate(rng.sample(mails, 30))]
    first = {c: min(t for _, x, t in mails if x == c) for _, c, _ in mails}  # a mail delivered again counts from its first delivery
    sent = {i: min(first[c] for x, c, _ in mails if x == i) for i, _, _ in mails}
    every = [(i, c, sent[i], thread_of(c), n, line) for i, c, _ in mails for n, line in enumerate(c.split("\n"), 1) if n >= 5 and len(line) >= 40]
    test, want = {}, set()
    for i, c, at, thread, n, t in every:
        for i2, c2, at2, thread2, _, t2 in every:
            if thread == thread2 and at2 < at and c != c2 and i != i2:
                if (t, t2) not in test:
                    test[t, t2] = Dictionary([t2]).repeats(t, overlap=0.9)
                if test[t, t2]:
                    want.add((i, n))
                    break
    df = spark.createDataFrame(mails, "raw_id string, content string, at timestamp")
    got = {(r.raw_id, r.line_no) for r in ancestor_lines(df, "raw_id", "content", "at").collect()}
    assert len(want) > 40 and got == want
