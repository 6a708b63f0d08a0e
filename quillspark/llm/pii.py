"""Problem 4: personal information in free text, by a skip-chain conditional random field over candidate spans.

Patterns and a given-name lexicon propose candidates with a wide net. A span is a node with a label out of none, email, phone,
id_number, address and name; its potentials are the scores of the patterns that propose it and log-linear in the features
of names. Neighbours in the text are linked in a chain; spans that repeat a value or a family name, and mail addresses that
spell a family name, by skip edges, however far apart. Loopy message passing makes the labels agree. The weights of names and
the potentials of both kinds of links are fitted together, on texts whose names are certain (mail headers, attendee lists,
the people table); everything is applied to all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import crf
from quillspark.plans.session import materialise
from quillspark.sources.tables import hash_sample

#: Bounds of the training alone: texts sampled for the weights and characters of each, family names whose form is learned. Candidates
#: come from all given names that LEAST_HEADERS headers or more have.
TRAIN_TEXTS, TRAIN_CHARS, FAMILY_NAMES, LEAST_HEADERS = 4000, 20_000, 8000, 3
GRAMS = 1 << 14
LABELS = ["none", "email", "phone", "id_number", "address", "name"]
LABEL = {k: i for i, k in enumerate(LABELS)}
#: Neighbours in a chain are at most so many characters apart.
CHAIN_GAP = 80

_S = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*(?:[>|][ \t>|]*)?)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]+"

# ---- fixed values: forms of what identifies a person -----------------------------------------------------
_EMAIL = [
    r"(?<![\w.+@-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w@])",
    rf"(?<![\w.+@-])[\w+-]+(?:(?:\.|{_S}dot{_S}|{_S}?[\[(]dot[\])]{_S}?)[\w+-]+)*{_S}?[\[({{]{_S}?at{_S}?[\])}}]{_S}?[\w-]+(?:(?:\.|{_S}dot{_S}|{_S}?[\[(]dot[\])]{_S}?)[\w-]+)*(?:\.|{_S}dot{_S}|{_S}?[\[(]dot[\])]{_S}?)[A-Za-z]{{2,}}(?![\w@])",
    rf"(?<![\w.+@-])[\w+.-]*[\w+-](?:{_S}dot{_S}[\w+-]+)*{_S}at{_S}[\w-]+(?:(?:{_S}dot{_S})[\w-]+)+(?![\w@])",
]
_PHONE = [
    r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)",
    r"(?<![\w+])\+(?=(?:[ .-]?\d){7})[1-9]\d{0,2}(?:[ .-]?\d{1,5}){2,6}(?![\w-])",  # +0530 is a zone
    r"(?<![\w+])00\d{2} ?\(0\)\d{1,4}[ /-]?\d{3,8}(?!\w)",
    r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)",
    r"(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])",
    r"(?<![\w.-])0\d{2,4}/\d{3,8}(?:-\d{1,5})?(?!\w)",
    r"(?<![\w.-])0\d{2}[ -]\d{4}[ -]\d{4}(?![\w-])",
    r"(?<![\w.-])07\d{3}[ -]\d{6}(?![\w-])",
    r"(?<![\w.-])0\d([ .-])\d\d\1\d\d\1\d\d\1\d\d(?![\w-])",
    r"(?<![\w.:-])1[2-9]\d{2}[2-9]\d{6}(?![\w-])",
]
_ID = [
    rf"(?<![\w-])[A-Z]{{2}}({_S}?)\d\d\1\d\d\1\d\d\1[A-D](?![\w-])",
    r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w-])\d{8}-?[A-Z](?![\w-])",
    rf"(?<![\w.$-])\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}(?![\w-])",
    r"(?<![\w-])X[A-Z]\d{7}(?![\w-])",
]
_WEAK_ID = [
    rf"(?<![\w.$-])\d{{3}}{_S}\d\d{_S}\d{{4}}(?![\w-])",
    r"(?<![\w.$:/=-])\d{11}(?![\w.:-])",
    r"(?<![\w.$:/=-])\d{9}(?![\w.:-])",
    r"(?<![\w-])[A-Z]{1,2}\d{6,9}(?![\w-])",
]
_ID_CUE = re.compile(r"(?:ssn|social(?:\s+security)?|security number|nino|\bni\b|insurance|taxpayer|tax\b|steuer|idnr|identi|\bid\b|dni|\bnie\b|\bnif\b|passport|travel\s+document|pasted|asked\s+whether|form\s+lists)[^\n;]{0,22}$", re.I)
_STREET = r"(?:Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Way|Hill|Mews|Square|Sq|Crescent|Terrace|Place|Pl|Close|Gardens|Boulevard|Blvd|Row|Park|Walk|Grove|Parade|Gate|Green)"
_TOWN = rf"{_CAP}(?:{_S}{_CAP})?"
_US, _UK = rf"[A-Z]{{2}}{_S}\d{{5}}(?:-\d{{4}})?", rf"[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}\d[A-Z]{{2}}"
_HOUSE = r"\d{1,5}(?:[ \t]?(?:bis|ter|[a-dA-D]))?(?!\w)"
_ADDRESS = [
    rf"(?<![\w$.-])(?:(?:Flat|Unit|Apt|Apartment|Suite){_S}\w+,{_S})?{_HOUSE}{_S}{_CAP}(?:{_S}{_CAP})?{_S}{_STREET}\b\.?(?:,?{_S}(?:Apt|Unit|Suite|Flat)\.?{_S}\w+)?(?P<tail>,{_S}{_CAP}(?:,?{_S}(?:{_US}|{_UK}))?)?",
    rf"(?<!\w){_CAP}?(?:[A-ZÀ-Þ]?[\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|berg)|{_S}(?:Straße|Allee|Weg|Platz|Gasse)){_S}{_HOUSE}(?P<tail>,{_S}\d{{5}}{_S}{_CAP})?",
    rf"(?<![\w$.-]){_HOUSE},?{_S}(?:rue|avenue|av\.|bd|boulevard|impasse|place|quai|chemin|allée|cours|route){_S}(?:(?:de{_S}la|de{_S}l|du|des|de|d){_S}|d['’])?{_CAP}(?:{_S}{_CAP})?(?P<tail>,{_S}\d{{5}}{_S}{_CAP})?",
    rf"(?<!\w)(?:Calle|C/|Avda\.|Avenida|Plaza|Pza\.|Paseo|Ronda|Camino){_S}(?:de{_S}(?:la{_S}|los{_S})?|del{_S})?{_CAP}(?:{_S}{_CAP})?,?{_S}{_HOUSE}(?:,{_S}\d{{1,2}}\.?[ºª°]{_S}?[A-Z]?\b)?(?P<tail>,{_S}\d{{5}}{_S}{_CAP})?",
    rf"(?<!\w)(?:P\.?{_S}?O\.?{_S}Box|Postfach|Apartado|BP){_S}\d{{1,6}}(?!\w)(?P<tail>,{_S}(?:\d{{5}}{_S})?{_CAP}(?:,?{_S}(?:{_US}|{_UK}))?)?",
]
_PARTICLE = rf"(?:(?:van|von|de|der|den|del|della|di|la|le|du|da|ter|ten|zu|el|al|bin|VAN|VON|DE|DER|DEN|DEL|LA|LE|DU|DA|Van|Von|De|La){_S})"
# ----------------------------------------------------------------------------------------------------------
_FORMS = {k: [re.compile(x) for x in v] for k, v in {"email": _EMAIL, "phone": _PHONE, "id_number": _ID, "address": _ADDRESS}.items()}
_WEAK = [re.compile(x) for x in _WEAK_ID]
_WORD = re.compile(r"[^\W\d_][\w’'-]*")
_AFTER = re.compile(rf"{_S}({_PARTICLE}{{0,3}}[^\W\d_][^\W_]*(?:[’'-][^\W\d_]+)*)")
_BEFORE = re.compile(rf"(?<![\w@.’'-])({_PARTICLE}{{0,3}}[^\W\d_][^\W_]*(?:[’'-][^\W\d_]+)*),?{_S}$")
_POSSESSIVE = re.compile(r"[’']s$", re.I)
TYPES = ["email", "phone", "id_number", "address", "name"]


@dataclass
class Node:
    start: int
    end: int
    kind: str
    score: float  # of the pattern; names get theirs from the model
    key: str  # what links nodes of one text
    given: str = ""
    family: str = ""
    feats: tuple = ()


@dataclass
class Span:
    """All candidates of one span: what it may be, and what links it to others."""

    start: int
    end: int
    options: list[Node]
    keys: set[str] = field(default_factory=set)
    alike: set[str] = field(default_factory=set)


def _family_key(family: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[>|]", " ", family)).split(" ")[-1].lower()


def _grams(word: str) -> list[int]:
    w = f"^{word.lower()}$"
    return [crc32(w[-n:].encode()) % GRAMS for n in range(2, 7)] + [crc32((str(n) + w[:n]).encode()) % GRAMS for n in (2, 3, 4)]


@dataclass
class Model:
    given: frozenset[str]
    family: frozenset[str]
    gram_weights: np.ndarray
    common: np.ndarray  # hashed share of a word's uses in lower case that aren't names
    weights: np.ndarray
    links: crf.Links = field(default_factory=lambda: crf.Links(len(LABELS)))


_CASES = {"title": 0, "upper": 1, "lower": 2, "mixed": 3}


def _case(w: str) -> str:
    if w.isupper() and len(w) > 1:
        return "upper"
    if w.islower():
        return "lower"
    return "title" if w[:1].isupper() else "mixed"


def name_candidates(text: str, given: frozenset[str]) -> list[Node]:
    """Given names with a word before or after them that might be the family name."""
    out = []
    for m in _WORD.finditer(text):
        word = m.group()
        if _POSSESSIVE.search(word):
            word = word[:-2]
        if word.lower() not in given or len(word) < 2:
            continue
        s, e = m.start(), m.start() + len(word)
        if s and (text[s - 1] in "@.+/-_" or (text[s - 1] == "<" and text[s - 2 : s] != "<v")) and text[s - 2 : s] != ". ":
            continue
        if e < len(text) and text[e] in "@+_/" or text[e : e + 1] == "." and text[e + 1 : e + 2].isalnum():
            continue
        if (f := _AFTER.match(text, e)) and e == m.end():
            fam = f[1]
            end = f.end(1)
            if _POSSESSIVE.search(fam):
                fam, end = fam[:-2], end - 2
            if len(fam.split()[-1]) > 1 and (text[end : end + 1] not in "@_+" or end == len(text)):
                out.append(Node(s, end, "name", 0.0, _family_key(fam), word, fam, (0, "\n" in text[e:end])))
        b = _BEFORE.search(text, max(0, s - 60), s)
        if b and len(b[1].split()[-1]) > 1:
            comma = "," in text[b.end(1) : s]
            out.append(Node(b.start(1), e, "name", 0.0, _family_key(b[1]), word, b[1], (1 if comma else 2, "\n" in text[b.end(1) : s])))
    return out


_RUN = re.compile(r"\d+")
_BRACKET_AT = re.compile(r"[\[({]\s?at\s?[\])}]")
_UNIT = re.compile(rf"(?<!\w)(?:Flat|Unit|Apt|Apartment|Suite){_S}$")
_LETTERS = re.compile(rf"(?<!\w)[A-Z]{{2}}{_S}$")
_GERMAN = ("traße", "trasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "berg", "Allee", "Weg", "Platz", "Gasse")
_SPANISH = ("Calle", "C/", "Avda.", "Avenida", "Plaza", "Pza.", "Paseo", "Ronda", "Camino")
_BOXES = ("Box", "Postfach", "Apartado", "BP")


def _plain_key(value: str) -> str:
    """A value without what writers vary: the same for all kinds, so that one value read in two ways is linked."""
    return re.sub("[^a-z0-9]", "", value.lower())


def pattern_candidates(text: str) -> list[Node]:
    """Spans of the fixed forms. The costly patterns are only tried where their rarest part stands: @, a run of digits, a street word."""
    out: list[Node] = []

    def add(kind: str, m: re.Match | None, score: float = 4.0) -> int:
        if m is None:
            return 0
        out.append(Node(m.start(), m.end(), kind, score, _plain_key(m.group()), m.group() if kind == "email" else ""))
        return m.end()

    email, bracketed, spelled = _FORMS["email"]
    at = text.find("@")
    while at >= 0:
        k = at
        while k > 0 and (text[k - 1].isalnum() or text[k - 1] in "._+-"):
            k -= 1
        while k < at and text[k] == ".":
            k += 1
        add("email", email.match(text, k))
        at = text.find("@", at + 1)
    if _BRACKET_AT.search(text):
        for m in bracketed.finditer(text):
            add("email", m)
    if "dot" in text:
        for m in spelled.finditer(text):
            add("email", m)
    english, german, french, spanish, box = _FORMS["address"]
    done, n = 0, len(text)
    for r in _RUN.finditer(text):
        s, e = r.span()
        before, after = text[s - 1 : s], text[e : e + 1]
        if s < done or (before == ":" and text[s - 2 : s - 1].isdigit()) or (after == ":" and text[e + 1 : e + 2].isdigit()):
            continue  # inside something found, or part of a clock time
        if e - s <= 5 and e < n and not after.isdigit():
            u = _UNIT.search(text, max(0, s - 14), s) if before.isspace() else None
            end = max(add("address", english.match(text, u.start())) if u else 0, add("address", english.match(text, s)), add("address", french.match(text, s)))
            if end:
                done = end
                continue
        starts = [s]
        if before in ("+", "("):
            starts.append(s - 1)
        elif before.isupper():
            k = s - 2 if text[s - 2 : s - 1].isupper() else s - 1
            starts = [max(0, k)]
        elif e - s == 2 and before.isspace() and (u := _LETTERS.search(text, max(0, s - 12), s)):
            starts.append(u.start())
        for k in starts:
            for f in _FORMS["phone"]:
                if m := f.match(text, k):
                    done = max(done, add("phone", m, 1.0 if _ID_CUE.search(text, max(0, k - 30), k) else 4.0))
            for f in _FORMS["id_number"]:
                done = max(done, add("id_number", f.match(text, k), 4.2))
            for f in _WEAK:
                if m := f.match(text, k):
                    add("id_number", m, 3.0 if _ID_CUE.search(text, max(0, k - 45), k) else -3.0)
    for words, form in ((_GERMAN, german), (_SPANISH, spanish), (_BOXES, box)):
        if any(w in text for w in words):
            for m in form.finditer(text):
                add("address", m)
    return out


def _name_features(text: str, n: Node, model: Model) -> np.ndarray:
    fam = n.family.split()[-1] if n.family.split() else n.family
    parts = [p for p in re.split(r"[-’']", fam) if len(p) > 2] or [fam]
    g, c = _case(n.given), _case(fam)
    grams = max(float(model.gram_weights[_grams(p)].mean()) for p in parts)
    common = float(model.common[crc32(fam.lower().encode()) % GRAMS])
    after = text[n.end : n.end + 2]
    before = text[max(0, n.start - 2) : n.start]
    return np.array([
        1.0, fam.lower() in model.family, grams, common, g == c, c == "title" and g == "title", c == "lower", n.feats[0] == 1, n.feats[0] == 2,
        n.feats[1], len(n.family.split()) > 1, fam.lower() in model.given, before.endswith("\n") or before == "", after[:1] in "<,:;.\n>", len(fam) < 4,
    ], dtype=float)


def spans(nodes: list[Node]) -> list[Span]:
    """Candidates of one span and one reading as one, in order of their start."""
    out: dict[tuple, Span] = {}
    for n in nodes:
        k = (n.start, n.end, n.feats if n.kind == "name" else ())
        s = out.setdefault(k, Span(n.start, n.end, []))
        s.options.append(n)
        if n.key:
            s.keys.add(n.key)
        if n.kind == "name":
            s.alike.add(n.key)
        elif n.kind == "email":
            s.alike |= _mail_words(n.given)
    return sorted(out.values(), key=lambda s: (s.start, s.end))


def _mail_words(value: str) -> set[str]:
    """The words of four letters or more before the sign `@` of a mail address."""
    return {w for w in re.split(r"[\W\d_]+", re.split(r"@|[\s\[({]at[\s\])}]", value.lower())[0]) if len(w) > 3}


def edges_of(found: list[Span], offset: int = 0) -> list[tuple[int, int, int]]:
    """(i, j, kind) edges: each span with the next that follows it closely, with the next one of the same key, and with the next that is alike.

    Linear in the spans, however often a value repeats.
    """
    out: list[tuple[int, int, int]] = []
    last: dict[tuple[int, str], int] = {}
    for k, s in enumerate(found):
        j = k + 1
        while j < len(found) and found[j].start < s.end:
            j += 1
        if j < len(found) and found[j].start - s.end <= CHAIN_GAP:
            out.append((offset + k, offset + j, crf.CHAIN))
        for kind, keys in ((crf.SAME, s.keys), (crf.ALIKE, s.alike)):
            for key in keys:
                if (kind, key) in last and found[last[kind, key]].end <= s.start and (kind == crf.SAME or found[last[kind, key]].keys.isdisjoint(s.keys)):
                    out.append((offset + last[kind, key], offset + k, kind))
                last[kind, key] = k
    return out


def _resolve(nodes: list[Node], belief: np.ndarray) -> list[Node]:
    """Non-overlapping nodes with positive belief, the surest first; an address gives up a tail that is someone's name."""
    names: list[Node] = []
    taken: list[tuple[int, int]] = []
    order = sorted((k for k in range(len(nodes)) if belief[k] > 0 and nodes[k].kind == "name"), key=lambda k: (-belief[k] + 1.5 * (nodes[k].feats[0] != 0), nodes[k].start))
    for k in order:
        n = nodes[k]
        if all(n.end <= a or n.start >= b for a, b in taken):
            taken.append((n.start, n.end))
            names.append(n)
    out: list[Node] = []
    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 3}
    others = sorted((k for k in range(len(nodes)) if belief[k] > 0 and nodes[k].kind != "name"), key=lambda k: (rank[nodes[k].kind], -belief[k] if nodes[k].kind != "address" else 0, nodes[k].start - nodes[k].end))
    spans: list[tuple[int, int]] = []
    for k in others:
        n = nodes[k]
        if n.kind == "address":
            for a, b in taken:
                if n.start < a < n.end:
                    n = Node(n.start, a, n.kind, n.score, n.key)
        if all(n.end <= a or n.start >= b for a, b in spans):
            spans.append((n.start, n.end))
            out.append(n)
    out.extend(n for n in names if all(n.end <= a or n.start >= b for a, b in spans))
    return out


def _potentials(text: str, s: Span, model: Model) -> np.ndarray:
    """Log potentials of a span's labels: 0 for none, the best score of each kind that proposes it, out of reach for the others."""
    u = np.full(len(LABELS), crf.FORBIDDEN)
    u[0] = 0.0
    for n in s.options:
        u[LABEL[n.kind]] = max(u[LABEL[n.kind]], float(_name_features(text, n, model) @ model.weights) if n.kind == "name" else n.score)
    return u


def candidates(text: str, model_given: frozenset[str]) -> list[Span]:
    return spans(pattern_candidates(text) + name_candidates(text, model_given)) if text else []


def find(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the personal information of each text."""
    per, unary, edges = [], [], []
    for text in texts:
        found = candidates(text, model.given)
        edges.extend(edges_of(found, len(unary)))
        unary.extend(_potentials(text, s, model) for s in found)
        per.append(found)
    belief = crf.propagate(np.array(unary).reshape(-1, len(LABELS)), np.array(edges, dtype=int).reshape(-1, 3), model.links)
    best = belief[:, 1:].argmax(1) + 1 if len(belief) else np.zeros(0, dtype=int)
    margin = belief[np.arange(len(belief)), best] - belief[:, 0] if len(belief) else np.zeros(0)
    out, k = [], 0
    for text, found in zip(texts, per):
        here = range(k, k + len(found))
        k += len(found)
        nodes = [next(n for n in s.options if n.kind == LABELS[best[i]]) if margin[i] > 0 else s.options[0] for i, s in zip(here, found)]
        kept = _resolve(nodes, margin[list(here)]) if nodes else []
        rows = []
        for n in kept:
            s, e = n.start, n.end
            while e > s and (text[e - 1].isspace() or text[e - 1] in ",;>|"):
                e -= 1
            rows.append((s, e, n.kind))
        out.append(sorted(rows))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 400, rate: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z = x / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += rate * (z.T @ (y - p) / len(y) - l2 * w)
    return w / scale


def train(sample: list[str], people: list[str], given: dict[str, int], family: dict[str, int], known: set[tuple[str, str]]) -> Model:
    """sample: texts; people: full names; given, family: in how many headers a word is a given or a family name; known: (given, family) of headers of the sample, lower case."""
    given, family, known = Counter(given), Counter(family), set(known)
    for name in people:
        parts = name.lower().split()
        if len(parts) >= 2 and all(_WORD.fullmatch(p) for p in parts):
            given[parts[0]] += 5
            family[parts[-1]] += 5
            known.add((parts[0], parts[-1]))
    g = frozenset(x for x, n in given.items() if n >= LEAST_HEADERS and n > 0.5 * family[x])
    f = frozenset(x for x, _ in family.most_common(FAMILY_NAMES) if x not in g)
    lower, capital, all_ = Counter(), Counter(), Counter()
    for t in sample:
        for m in _WORD.finditer(t):
            w = m.group()
            all_[w.lower()] += 1
            if w.islower():
                lower[w] += 1
            elif w[:1].isupper():
                capital[w.lower()] += 1
    common = np.zeros(GRAMS)
    for w, n in lower.items():
        if w not in f and w not in g:
            k = crc32(w.encode()) % GRAMS
            common[k] = max(common[k], min(1.0, n / 10))
    # family names against other words, by the letters they begin and end with
    words = [(w, 1.0) for w in f] + [(w, 0.0) for w, n in all_.items() if w not in f and w not in g and len(w) > 2 and (capital[w] >= 3 or lower[w] >= 3)]
    weights = np.zeros(GRAMS)
    rng = np.random.default_rng(7)
    idx = [np.array(_grams(p)) for w, _ in words for p in [re.split(r"[-’']", w)[-1] or w]]
    share = sum(y for _, y in words) / max(1, len(words))
    at, label = np.array(idx).reshape(-1, 8), np.array([y for _, y in words])
    for epoch in range(6):
        order = rng.permutation(len(words))
        for s in range(0, len(order), 16):
            k = order[s : s + 16]
            p = 1 / (1 + np.exp(-np.clip(weights[at[k]].sum(1), -30, 30)))
            step = 0.3 / (1 + epoch) * (label[k] - p) * np.where(label[k] == 1, 1 - share, share) * 2
            np.add.at(weights, at[k], step[:, None])
    model = Model(g, f, weights, common, np.zeros(15))
    base, xs, guess, sure, edges = [], [], [], [], []
    for t in sample:
        found = candidates(t, g)
        edges.extend(edges_of(found, len(base)))
        for span in found:
            u, x, y, certain = np.full(len(LABELS), crf.FORBIDDEN), np.zeros(15), 0, True
            u[0] = 0.0
            for n in span.options:
                if n.kind != "name":
                    u[LABEL[n.kind]] = max(u[LABEL[n.kind]], n.score)
                    continue
                u[LABEL["name"]] = 0.0
                x = _name_features(t, n, model)
                fam = _family_key(n.family)
                if (n.given.lower(), fam) in known:
                    y = LABEL["name"]
                elif fam in f:
                    y, certain = LABEL["name"] if _case(n.given) == _case(n.family.split()[-1]) else 0, False
                if rng.random() < 0.5:
                    x[1] = 0.0  # families that no list knows must be told by their form
            if y == 0 and span.options[0].kind != "name":
                top = int(u.argmax())
                y, certain = top, u[top] >= 3 or top == 0
            base.append(u)
            xs.append(x)
            guess.append(y)
            sure.append(certain)
    sure = np.array(sure, dtype=bool)
    is_name = np.array([u[LABEL["name"]] == 0.0 for u in base], dtype=bool)
    ys = np.array(guess, dtype=int)
    if len(set(ys[sure & is_name])) == 2:
        first = _logistic(np.array(xs)[sure & is_name], (ys[sure & is_name] == LABEL["name"]).astype(float), 1e-4)
        model.weights, model.links = crf.fit(np.array(base), np.array(xs), LABEL["name"], ys, sure, np.array(edges, dtype=int).reshape(-1, 3), first)
    else:
        model.weights = np.array([-1.0, 2, 1, -3, 0.5, 1, -0.5, 0, -1, -0.5, 0.5, -1, 0, 0.5, -0.5])
    return model


_HEADER = r"(?m)^(?:From|To|Cc|Attendees): ([^\n]*)"
_FULL = r"^\p{Lu}[\p{L}'’-]+( [\p{L}'’-]+){1,4}$"


def header_words(texts: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """In how many headers and attendee lists each word is a given, and a family name: counted over all texts.

    All given names that LEAST_HEADERS have come back, a vocabulary that hardly grows with the texts; of the family names, whose
    forms are learned, the FAMILY_NAMES most frequent.
    """
    lines = F.regexp_extract_all("text", F.lit(_HEADER), F.lit(1))
    names = texts.select(F.explode(lines).alias("line")).select(F.explode(F.split("line", r",\s*")).alias("x"))
    names = names.select(F.trim(F.regexp_replace("x", r"\s*[<(].*$", "")).alias("name")).filter(F.col("name").rlike(_FULL))
    parts = F.split(F.lower("name"), " ")
    words = names.select(F.explode(F.array(F.struct(parts[0].alias("word"), F.lit(True).alias("given")), F.struct(F.element_at(parts, -1).alias("word"), F.lit(False).alias("given")))).alias("w")).select("w.*")
    counted = materialise(words.groupBy("word").agg(F.count_if("given").alias("g"), F.count_if(~F.col("given")).alias("f")), "p4-words")
    given = counted.filter((F.col("g") >= LEAST_HEADERS) & (F.col("g") > F.col("f") / 2)).collect()
    family = counted.filter("f > 0").orderBy(F.desc("f"), "word").limit(FAMILY_NAMES).collect()
    return {r["word"]: int(r["g"]) for r in given}, {r["word"]: int(r["f"]) for r in [*given, *family] if r["f"]}


def names_in_headers(text: str) -> set[tuple[str, str]]:
    """(given, family) of a text's headers, lower case."""
    out = set()
    for line in re.findall(r"(?m)^(?:From|To|Cc|Attendees): ([^\n]*)", text):
        for x in re.split(r",\s*", line):
            parts = re.sub(r"\s*[<(].*$", "", x).strip().split(" ")
            if 2 <= len(parts) <= 5 and parts[0][:1].isupper() and all(_WORD.fullmatch(p) for p in parts):
                out.add((parts[0].lower(), parts[-1].lower()))
    return out


def fit(texts: DataFrame, people: DataFrame, at_most: int = TRAIN_TEXTS) -> Model:
    """Fit on at most `at_most` texts, half of them of 400 characters or more, because names repeat there; texts: (text)."""
    t = texts.filter("text is not null").select("text")
    parts = [hash_sample(t.filter(cond), F.col("text"), at_most // 4) for cond in ("length(text) >= 400", "length(text) < 400")]
    sample = sorted(r["t"] for p in parts for r in p.select(F.substring("text", 1, TRAIN_CHARS).alias("t")).collect())
    full = [r["full_name"] for r in people.filter("full_name is not null").select("full_name").collect()]  # a fixed table
    given, family = header_words(t)
    known = {x for s in sample for x in names_in_headers(s)}
    return train(sample, full, given, family, {x for x in known if family.get(x[1], 0) > 0})


def find_pii(texts: DataFrame, model: Model) -> DataFrame:
    """(src, row_key, start_pos, end_pos, pii_type) of texts (src, row_key, text), positions in characters, ends exclusive.

    Null and empty texts have none; repeated rows give repeated finds; spans of one text never overlap.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 1000):
                part = batch.iloc[s : s + 1000]
                found = find(list(part["text"]), model)
                rows = [(a, b, x, y, k) for a, b, f in zip(part["src"], part["row_key"], found) for x, y, k in f]
                yield pd.DataFrame(rows, columns=["src", "row_key", "start_pos", "end_pos", "pii_type"])

    return texts.filter("text is not null and text <> ''").select("src", "row_key", "text").mapInPandas(go, "src string, row_key string, start_pos int, end_pos int, pii_type string")


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder of its type for each find; everything else unchanged."""
    out, at = [], 0
    for s, e, kind in sorted(found):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def mask_pii(texts: DataFrame, model: Model) -> DataFrame:
    """(src, row_key, masked) of texts (src, row_key, text); null texts stay null."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 1000):
                part = batch.iloc[s : s + 1000]
                texts_ = [t or "" for t in part["text"]]
                masked = [redact(t, f) if raw is not None else None for raw, t, f in zip(part["text"], texts_, find(texts_, model))]
                yield pd.DataFrame({"src": part["src"], "row_key": part["row_key"], "masked": masked})

    return texts.select("src", "row_key", "text").mapInPandas(go, "src string, row_key string, masked string")
