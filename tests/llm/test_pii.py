import numpy as np
import pytest

from quillspark.llm import pii
from quillspark.llm.crf import ALIKE, CHAIN, FORBIDDEN, SAME, Links, propagate
from quillspark.llm.pii import find, find_pii, mask_pii, redact, train


@pytest.fixture(scope="module")
def model():
    given = ["Ann", "Bob", "Zoë", "Max"]
    family = ["Dobrowick", "Harrowmann", "Stelova", "Quintini", "Brassen", "Fod"]
    people = [f"{g} {f}" for g in given for f in family]
    texts = [f"From: {p} <x@y.test>\nTo: b\n\nHi,\n\n{p} moved the plan. {p.split()[0]} will check the build. In Korvel, {p.split()[0]} wrote that it works." for p in people] * 4
    return train(texts, people, {g.lower(): 24 for g in given}, {f.lower(): 16 for f in family}, {(g.lower(), f.lower()) for g in given for f in family})


def got(model, text):
    return [(text[a:b], k) for a, b, k in find([text], model)[0]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail ann.d+x@a.example.org or mailto:b@c.test now", [("ann.d+x@a.example.org", "email"), ("b@c.test", "email")]),
        ("write a.b [at] c.example or d dot e at f dot test.", [("a.b [at] c.example", "email"), ("d dot e at f dot test", "email")]),
        ("Pinned field@7.19.16 in the lockfile", []),
        ("call +44 20 7946 0257, (658) 555 0182 or 01.99.00.83.99", [("+44 20 7946 0257", "phone"), ("(658) 555 0182", "phone"), ("01.99.00.83.99", "phone")]),
        ("0049 (0)30 23125183; 030/23125-105; 07700 900804; 16805550131", [("0049 (0)30 23125183", "phone"), ("030/23125-105", "phone"), ("07700 900804", "phone"), ("16805550131", "phone")]),
        ("Date: Fri, 02 Jan 2026 18:24:16 +0530, then +447700900870", [("+447700900870", "phone")]),
        ("Thread 1782365520.815704 has it, Batch 3100-80-7699, INC-239338, 96-166 ms", []),
        ("SSN 952-00-2026, NI number QQ 02 10 26 D, passport no. XZ3709846", [("952-00-2026", "id_number"), ("QQ 02 10 26 D", "id_number"), ("XZ3709846", "id_number")]),
        ("Steuer-ID: 06 485 948 176 and DNI 46335195-U", [("06 485 948 176", "id_number"), ("46335195-U", "id_number")]),
        ("social security 918004145 but 918004145 rows", [("918004145", "id_number"), ("918004145", "id_number")]),
        ("ship to 276 Flauzeal Road, Moupearton ME 00906, today", [("276 Flauzeal Road, Moupearton ME 00906", "address")]),
        ("Flat 4, 323 Thakled Lane, Giflaskville QQ3 6ZZ", [("Flat 4, 323 Thakled Lane, Giflaskville QQ3 6ZZ", "address")]),
        ("the Livor Lane release and the Grisiosk Street pilot (342 units)", []),
        ("Deasairplatz 145, 00259 Grefandburg; 353 bis, rue Vaihauth, 00926 Dashioxton; PO Box 823, Rupuvville", [("Deasairplatz 145, 00259 Grefandburg", "address"), ("353 bis, rue Vaihauth, 00926 Dashioxton", "address"), ("PO Box 823, Rupuvville", "address")]),
        ("Dr. Ann Dobrowick's note", [("Ann Dobrowick", "name")]),
        ("ask Brassen, Max or ZOË STELOVA or bob quintini", [("Brassen, Max", "name"), ("ZOË STELOVA", "name"), ("bob quintini", "name")]),
        ("Ann will call Bob, and Max wrote.", []),
        ("", []),
    ],
)
def test_finds(model, text, want):
    assert got(model, text) == want


def test_unlisted_family_by_its_form(model):
    assert got(model, "Who is Ann Krellowick? They call.") == [("Ann Krellowick", "name")]


def exact(unary, edges, links):
    """Marginals by enumeration."""
    import itertools

    out = np.zeros(unary.shape)
    tables = links.tables()
    for y in itertools.product(range(unary.shape[1]), repeat=len(unary)):
        p = np.exp(sum(unary[i, v] for i, v in enumerate(y)) + sum(tables[k][y[i], y[j]] for i, j, k in edges))
        for i, v in enumerate(y):
            out[i, v] += p
    return out / out.sum(1, keepdims=True)


def test_messages_on_a_tree_are_exact():
    rng = np.random.default_rng(1)
    unary = rng.normal(size=(5, 3))
    unary[2, 1] = FORBIDDEN
    edges = np.array([(0, 1, CHAIN), (1, 2, SAME), (1, 3, ALIKE), (3, 4, CHAIN)])
    links = Links(3, np.array([[0, 0, 0], [0, 0.7, -0.4], [0, 0.2, 0.1]]), 1.2, 0.8)
    b = propagate(unary, edges, links, 40)
    p = np.exp(b - b.max(1, keepdims=True))
    assert np.allclose(p / p.sum(1, keepdims=True), exact(unary, edges, links), atol=1e-6)


def test_skip_edges_carry_labels(model):
    model = pii.Model(model.given, model.family, model.gram_weights, model.common, model.weights, Links(6, None, 2.5, 0.0))
    far = "918004145 rows were read.\n" + "Nothing of note here.\n" * 40
    assert got(model, far) == [] and got(model, far + "social security 918004145, SSN 918004145, SSN 918004145")[0] == ("918004145", "id_number")
    off = pii.Model(model.given, model.family, model.gram_weights, model.common, model.weights)
    assert len(got(off, far + "social security 918004145, SSN 918004145, SSN 918004145")) == 3


def test_edges():
    text = "Ann Dobrowick <ann.dobrowick@a.test>; " + "x" * 200 + " Max Dobrowick"
    found = pii.candidates(text, frozenset(["ann", "max"]))
    kinds = [k for _, _, k in pii.edges_of(found)]
    assert kinds.count(SAME) == 1 and ALIKE in kinds and CHAIN in kinds
    assert len(pii.edges_of(pii.candidates("a@b.test " * 500, frozenset()))) == 998  # one chain and one skip edge a repeat


def test_fitting_learns_to_agree():
    # pairs of nodes that repeat a value always have one label; one of them shows it, the other is undecided
    from quillspark.llm import crf

    rng = np.random.default_rng(2)
    n = 400
    y = np.repeat(rng.integers(0, 2, n // 2), 2)
    x = np.column_stack([np.where(np.arange(n) % 2 == 0, 2.0 * y - 1, 0.0), np.ones(n)])
    edges = np.array([(i, i + 1, SAME) for i in range(0, n, 2)])
    w, links = crf.fit(np.zeros((n, 2)), x, 1, y, np.ones(n, dtype=bool), edges, np.zeros(2), steps=600)
    unary = np.column_stack([np.zeros(n), x @ w])
    b = propagate(unary, edges, links)
    assert links.same > 0.5 and ((b[1::2, 1] > b[1::2, 0]) == (y[1::2] == 1)).mean() > 0.9


def everywhere(text):
    """All patterns tried at every character: what the anchored search must not miss."""
    out = []
    for kind, forms in pii._FORMS.items():
        for f in forms:
            for k in range(len(text)):
                if m := f.match(text, k):
                    out.append((m.start(), m.end(), kind))
    return out


def test_anchored_search_misses_nothing():
    import glob

    import duckdb

    texts = []
    for path, col in (("slack_messages", "text"), ("raw_items", "content")):
        for f in glob.glob(f"/root/testdata/sf0.001/{path}.parquet"):
            texts += [r[0][:3000] for r in duckdb.sql(f"select {col} from '{f}' where {col} is not null").fetchall()]
    texts += ["x.y@a.b.test,+44 20 7946 0257;(658) 555 0182; 0049 (0)30 23125183 Flat 4, 323 Thakled Lane, Giflaskville QQ3 6ZZ", "an AB 12 34 56 C, 12:30 at 5 Rue Road", "a [at] b.test d dot e at f dot test"]
    longest = lambda spans: {(s, e, k) for s, e, k in spans if not any(a <= s and e <= b and (a, b) != (s, e) for a, b, _ in spans)}
    missed = [(t[s - 20 : e + 20], k) for t in texts for s, e, k in longest(everywhere(t)) - {(n.start, n.end, n.kind) for n in pii.pattern_candidates(t)}]
    assert texts and missed == []


def test_redaction_keeps_the_rest(model):
    t = "Zoë: mail ann.d@a.test — naïve 😀 +44 20 7946 0257 end"
    masked = redact(t, find([t], model)[0])
    assert masked == "Zoë: mail [EMAIL] — naïve 😀 [PHONE] end"


def test_frames(spark, model):
    df = spark.createDataFrame([("s", "1", "mail a@b.test", "n"), ("s", "1", "mail a@b.test", "n"), ("s", "2", None, "n"), ("s", "3", "", "n"), ("s", "4", "x " * 300000 + "a@b.test", "n")], "src string, row_key string, text string, pii_type string")
    assert find_pii(df, model).count() == 3
    m = {r.row_key: r.masked for r in mask_pii(df, model).collect()}
    assert m["1"] == "mail [EMAIL]" and m["2"] is None and m["3"] == "" and m["4"].endswith("x [EMAIL]")
    assert find_pii(df.filter("false"), model).count() == 0
