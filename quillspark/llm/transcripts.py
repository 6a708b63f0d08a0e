"""Problem 7: speech transcripts into clean, ordered speaker turns.

A transcript of any layout (cues with or without voice tags, timed or plain lines, label lines) is parsed into segments.
Whether a segment begins a new turn is a boosted-tree decision over its label, the gap and the context, learned from
transcripts whose labels are certain. Filler words are classified per token, by a model of how a language's tokens are used in all
transcripts: how often they are set off the way hesitations are, open a turn, stand alone, and in how many languages
they do so. Labels of all spellings of a speaker give one name.
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

from quillspark.llm.boosting import BoostedTrees, binned
from quillspark.plans.session import materialise
from quillspark.sources.tables import hash_sample

#: Bounds of training_sample alone, which no query uses: they learn from all transcripts.
TRAIN_TRANSCRIPTS, TRAIN_CHARS = 1500, 200_000
#: Bins of a feature: cases that share all bins are one row of the fit, so its rows grow far slower than the cases.
BINS, FEATURES = 16, 12
#: A token is judged if it is set off so many times and in such a share of its uses; from SURE on it is an example of a filler, up to DOUBTFUL of
#: a word. Both classes must have LEAST_EXAMPLES, else the share between them decides.
LEAST_SET_OFF, LEAST_SHARE, DOUBTFUL, SURE, LEAST_EXAMPLES, BETWEEN = 3, 0.005, 0.06, 0.3, 8, 0.12
BUCKETS = 1 << 15

_T = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,6})?"
_CUE = re.compile(rf"^\s*({_T})\s*-->\s*({_T})")
_VOICE = re.compile(r"^\s*<v(?:\.[^\s>]*)?\s+([^>]*)>(.*)$")
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TIMED = re.compile(rf"^\s*(?:\[({_T})\]|\(({_T})\)|({_T}))\s*(?:[-–—|]\s*)?(.*)$")
_LABEL_TIME = re.compile(rf"^\s*(\S.*?)\s+(?:\[({_T})\]|\(({_T})\)|({_T}))\s*:?\s*$")
_LABELLED = re.compile(r"^\s*([^:\n]{1,70}?)\s*:(?:\s+|$)(.*)$")
_DASHED = re.compile(r"^\s*([^:\n]{1,70}?)\s*(?::|\s[-–—])(?:\s+|$)(.*)$")  # after a time a dash may close the label
_HEADER = re.compile(r"^(?:# .*|_source path: .*|_modified: .*|```.*|~~~.*|WEBVTT.*|NOTE(?: .*)?|STYLE|REGION|Transcription ended.*|\d{4}-\d\d-\d\d \d\d:\d\d(?::\d\d)? ?(?:UTC|Z)?)$")
_PRESENT = re.compile(r"^(?:Attendees|Participants|Present)\s*:\s*(.*)$", re.I)
_REMARK = re.compile(r"\[[^\]\n]*\]|\(\([^)\n]*\)\)|♪[^♪\n]*♪?|(?<!\S)\*[^*\n]{1,40}\*|\((?:[^\W\d_]+[ '-]?){1,4}(?:\d{1,2}:\d\d(?::\d\d)?)?\)")
_NUMBERED = re.compile(r"^\s*(?:speaker|sprecher(?:in)?|locuteur|hablante|spk)[\s_#-]*0*(\d+)\s*$", re.I)
_PIECE = re.compile(r"\S+")
_WORDLIKE = re.compile(r"[^\W_]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")

# Frequent short words that tell the languages of the texts apart.
_COMMON = {
    "en": frozenset("the and is of to that was for with from while until has we our be".split()),
    "de": frozenset("der die das den und ist nicht wird wir ein eine mit noch bis für zum sind".split()),
    "fr": frozenset("le la les des est et du un une pour avec que nous dans sur pas".split()),
    "es": frozenset("el los las es y del una por con que se para en antes no hay".split()),
}


@dataclass
class Segment:
    start: float | None
    end: float | None
    label: str | None
    certain: bool
    text: str
    timed: bool = False


@dataclass
class Transcript:
    segments: list[Segment]
    present: set[str] = field(default_factory=set)
    language: str = "en"


def _seconds(t: str) -> float:
    out = 0.0
    for part in t.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


def speaker_name(label: str) -> str:
    """The given name in lower case, or `speaker 3`; remarks on role or team fall away, `Family, Given` is turned round."""
    s = re.sub(r"\s*[\[(][^\])]*[\])]\s*", " ", label)
    s = re.split(r"\s+[/|–—-]\s+|\s*/\s*", s)[0].strip(" \t:*_-")
    if m := _NUMBERED.match(s):
        return f"speaker {int(m[1])}"
    if "," in s:
        after = s.split(",", 1)[1].strip()
        s = after or s
    return (s.split() or [""])[0].strip(".,").lower()


def parse(content: str) -> Transcript:
    lines = re.sub(r"\r\n?", "\n", content).split("\n")
    out = Transcript([])
    cue: tuple[float, float] | None = None
    n = len(lines)
    head = True  # until the first cue, time or blank line after a title
    open_label: Segment | None = None
    titled = False
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            if titled:
                head = False
            if cue is not None:
                cue = None
            continue
        if m := _CUE.match(s):
            cue, head = (_seconds(m[1]), _seconds(m[2])), False
            out.segments.append(Segment(cue[0], cue[1], None, False, ""))
            open_label = out.segments[-1]
            continue
        if _HEADER.match(s):
            titled = titled or s[0].isdigit()
            continue
        if m := _PRESENT.match(s):
            out.present |= {speaker_name(x) for x in re.sub(r"\([^)]*\)", "", m[1]).split(",") if x.strip()}
            titled = True
            continue
        if s.isdigit() and i + 1 < n and _CUE.match(lines[i + 1]):
            continue
        if cue is not None and open_label is not None:
            if m := _VOICE.match(s):
                if open_label.text and open_label.label is not None and open_label.label != m[1].strip():
                    out.segments.append(Segment(cue[0], cue[1], None, False, ""))
                    open_label = out.segments[-1]
                open_label.label, open_label.certain = m[1].strip(), True
                s = m[2]
            s = _TAG.sub("", s)
            open_label.text = f"{open_label.text} {s}".strip()
            continue
        m = _LABEL_TIME.match(s)
        if m and (name := m[1].strip().rstrip(":")) and not _TIMED.match(s) and len(name) <= 70 and not re.search(r"[.!?]\s|[.!?…]$", name.replace("O'", "").rstrip(".")):
            at = _seconds(m[2] or m[3] or m[4])
            open_label, head = Segment(at, None, name, True, ""), False
            out.segments.append(open_label)
            continue
        if m := _TIMED.match(s):
            at, rest, head = _seconds(m[1] or m[2] or m[3]), m[4], False
            if not rest:  # a label stands alone on the line before
                if out.segments and out.segments[-1].start is None and not out.segments[-1].certain and lines[i - 1].strip() == out.segments[-1].text:
                    out.segments[-1] = Segment(at, None, out.segments[-1].text.rstrip(":"), True, "")
                    open_label = out.segments[-1]
                elif out.segments and out.segments[-1].text.endswith("\n" + lines[i - 1].strip()):
                    last = out.segments[-1]
                    last.text = last.text[: -len(lines[i - 1].strip()) - 1]
                    open_label = Segment(at, None, lines[i - 1].strip().rstrip(":"), True, "")
                    out.segments.append(open_label)
                continue
            open_label = Segment(at, None, None, False, rest, True)
            out.segments.append(open_label)
            continue
        if head and not _LABELLED.match(s):
            titled = True
            nxt = next((x.strip() for x in lines[i + 1 : i + 2]), "")
            if not (nxt and _TIMED.match(nxt) and not _TIMED.match(nxt)[4]):
                continue
        if _LABELLED.match(s) or open_label is None or not (open_label.certain or open_label.start is not None or open_label.label):
            if open_label is not None and open_label.certain:
                open_label.text = f"{open_label.text}\n{s}".strip(" ")
                continue
            open_label = Segment(None, None, None, False, s)
            out.segments.append(open_label)
        else:
            open_label.text = f"{open_label.text}\n{s}".strip(" ")
    for g in out.segments:
        if not g.certain and (m := (_DASHED if g.timed else _LABELLED).match(g.text.split("\n")[0])) and not _REMARK.fullmatch(m[1]) and not re.search(r"[.!?;]\s", m[1]):
            g.label = m[1]
    timed = [g for g in out.segments if g.start is not None]
    if timed:
        joined: list[Segment] = []
        for g in out.segments:  # lines without time belong to the timed one before them
            if g.start is None and joined:
                g.start = joined[-1].start
            joined.append(g)
        lead = timed[0].start
        for g in joined:
            g.start = lead if g.start is None else g.start
        out.segments = sorted(joined, key=lambda g: g.start)
    words = Counter(re.findall(r"[^\W\d_]+", " ".join(g.text for g in out.segments).lower()))
    out.language = max(_COMMON, key=lambda k: (sum(words[w] for w in _COMMON[k]), k == "en"))
    return out


def _bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


_NAME = re.compile(r"^(?:[^\W\d_][\w'’.-]*,?\s*){1,5}(?:[\[(][^\])]*[\])]|/\s*\w+)?$")
_SENTENCE_END = re.compile(r"[.!?…][\"')\]]*\s*$")


def features(t: Transcript, odds: np.ndarray) -> np.ndarray:
    """A row per segment: its label, the gap to the segment before, and the context."""
    names = [speaker_name(g.label) if g.label else "" for g in t.segments]
    times = Counter(x for x in names if x)
    n = max(1, len(names))
    certain = sum(g.certain for g in t.segments) / n
    out = np.zeros((len(names), FEATURES))
    last = ""
    for i, g in enumerate(t.segments):
        before = t.segments[i - 1] if i else None
        rest = g.text
        if g.label:
            first = re.split(r"[\s,]+", g.label.strip())[0].lower().strip(".")
            shape = _NAME.match(g.label) is not None
            rest = g.text if g.certain else g.text[len(g.label) :].lstrip(" :-–—\n")
            out[i, :8] = [g.certain, 1, len(g.label.split()), shape, names[i] in t.present, times[names[i]] / n, odds[_bucket(names[i] if not names[i].startswith("speaker ") else "speaker")], odds[_bucket(first)]]
            out[i, 8] = names[i] != last
        if before is not None and g.start is not None and before.start is not None:
            out[i, 9] = min(60.0, g.start - (before.end if before.end is not None else before.start))
        said = _REMARK.sub(" ", before.text).rstrip() if before is not None else ""
        out[i, 10] = (not said or bool(_SENTENCE_END.search(said))) + 2 * rest[:1].islower()
        out[i, 11] = certain
        last = names[i] or last
    return out


@dataclass
class Model:
    odds: np.ndarray
    trees: BoostedTrees
    fillers: dict[str, frozenset[str]]


_NO_CASES = np.zeros((2, FEATURES)), np.array([0.0, 1.0])
_SET_OFF = re.compile(r"(?<![\w'’-])([^\W\d_]+(?:[-'’][^\W\d_]+)*)(\.\.\.|…|—| --)")
_TOKEN = re.compile(r"(?<![\w'’-])[^\W\d_]+(?:[-'’][^\W\d_]+)*(?![\w'’-])")


def corpus_counts(items: DataFrame, text_col: str) -> DataFrame:
    """Over all transcripts, in one pass: per (language, token) how often it is used, set off, opens a segment and stands alone in it
    (n, off, first, alone), and per bucket of words how often they stand in labels and before a colon within speech (n, off)."""
    rows = items.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c: dict[tuple[str, str], list[int]] = {}
            labels: dict[int, list[int]] = {}
            for content in batch["text"]:
                t = parse(content)
                _count_labels(t, labels)
                for g in t.segments:
                    said = g.text if g.certain or not g.label else g.text[len(g.label) :].lstrip(" :-–—")
                    words = [m.group().lower() for m in _TOKEN.finditer(g.text)]
                    for w in words:
                        c.setdefault((t.language, w), [0, 0, 0, 0])[0] += 1
                    for m in _SET_OFF.finditer(g.text):
                        c.setdefault((t.language, m[1].lower()), [0, 0, 0, 0])[1] += 1
                    if opening := _TOKEN.search(said):
                        x = c.setdefault((t.language, opening.group().lower()), [0, 0, 0, 0])
                        x[2] += 1
                        x[3] += _EDGE.sub("", said) == opening.group()
            out = [(*k, None, *v) for k, v in c.items()] + [(None, None, k, *v, 0, 0) for k, v in labels.items()]
            yield pd.DataFrame(out, columns=["language", "token", "bucket", "n", "off", "first", "alone"]).astype({"bucket": "Int32"})

    counted = rows.mapInPandas(go, "language string, token string, bucket int, n long, off long, first long, alone long")
    return counted.groupBy("language", "token", "bucket").agg(*[F.sum(x).alias(x) for x in ("n", "off", "first", "alone")])


def classify_tokens(uses: list[tuple[str, str, int, int, int, int]]) -> dict[str, frozenset[str]]:
    """Fillers per language among (language, token, n, off, first, alone).

    A logistic model of a token's uses is fitted on those that are plainly fillers or plainly words, and applied to all. What
    hesitates in two languages does so in all, unless it is a common word of this one.
    """
    share = {(k, w): off / max(1, n) for k, w, n, off, *_ in uses}
    langs = Counter(w for k, w, *_ in uses if share[k, w] >= BETWEEN)
    x = np.array([[1.0, min(1.0, off / max(1, n)), first / max(1, n), alone / max(1, n), len(w) <= 4, langs[w] > 1] for k, w, n, off, first, alone in uses]).reshape(-1, 6)
    s = x[:, 1]
    sure, doubtful = s >= SURE, s <= DOUBTFUL
    filler = s >= BETWEEN
    if sure.sum() >= LEAST_EXAMPLES and doubtful.sum() >= LEAST_EXAMPLES:
        known = sure | doubtful
        z, y, w = x[known], sure[known].astype(float), np.zeros(6)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(2000):
            w += 2.0 * (z.T @ (weight * (y - 1 / (1 + np.exp(-z @ w)))) / len(y) - 1e-4 * w)
        filler = x @ w > 0
    out = {k: {u[1] for u, is_filler in zip(uses, filler) if is_filler and u[0] == k} for k in _COMMON}
    everywhere = Counter(w for v in out.values() for w in v)
    known_share = {k: share for k, share in share.items()}
    for k in out:
        out[k] |= {w for w, n in everywhere.items() if n >= 2 and known_share.get((k, w), 1.0) >= 0.05}
    return {k: frozenset(v) for k, v in out.items()}


def learn_fillers(items: DataFrame, text_col: str) -> dict[str, frozenset[str]]:
    """Fillers per language, from the uses of all tokens in all transcripts."""
    return _fillers(corpus_counts(items, text_col))


def _fillers(counts: DataFrame) -> dict[str, frozenset[str]]:
    """Only tokens that are set off often enough come back."""
    often = counts.filter("bucket is null").filter((F.col("off") >= LEAST_SET_OFF) & (F.col("off") >= LEAST_SHARE * F.col("n")))
    return classify_tokens(sorted(tuple(r) for r in often.drop("bucket").collect()))


def _count_labels(t: Transcript, counts: dict[int, list[int]]) -> None:
    """Add to the numbers of a bucket how often its words stand in labels, and how often before a colon within speech."""
    for x in t.present:
        counts.setdefault(_bucket(x), [0, 0])[0] += 1
    for g in t.segments:
        if g.certain and g.label:
            counts.setdefault(_bucket("speaker" if (x := speaker_name(g.label)).startswith("speaker ") else x), [0, 0])[0] += 1
            counts.setdefault(_bucket(re.split(r"[\s,]+", g.label.strip())[0].lower().strip(".")), [0, 0])[0] += 1
            if ":" not in g.text:
                continue
            for s in re.split(r"(?<=[.!?])\s+", _REMARK.sub(" ", g.text)):
                if m := _LABELLED.match(s):
                    counts.setdefault(_bucket(speaker_name(m[1])), [0, 0])[1] += 1
                    counts.setdefault(_bucket(m[1].split()[0].lower()), [0, 0])[1] += 1


def _odds(counts: dict[int, list[int]]) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for k, (label, content) in counts.items():
        out[k] = np.log((1 + label) / (1 + content))
    return out


def _odds_without(t: Transcript, counts: dict[int, list[int]], odds: np.ndarray) -> np.ndarray:
    """The odds as they were without this transcript: a name that it alone has must look new to the fit, as it will in other transcripts."""
    own: dict[int, list[int]] = {}
    _count_labels(t, own)
    out = odds.copy()
    for k, (label, content) in own.items():
        out[k] = np.log((1 + counts[k][0] - label) / (1 + counts[k][1] - content))
    return out


def cases(t: Transcript, counts: dict[int, list[int]], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and answers of a transcript of those counted, if its labels are certain. They are also written as `Label: text` lines,
    which with cut and unlabelled speech gives cases for every layout."""
    sure = [g for g in t.segments if g.certain and g.label and g.text]
    if len(sure) < 3:
        return np.zeros((0, FEATURES)), np.zeros(0)
    odds = _odds_without(t, counts, odds)
    plain = Transcript([], t.present, t.language)
    y, last = [], ""
    for i, g in enumerate(sure):
        name = speaker_name(g.label)
        bare = name == last and i % 2 == 0
        said = g.text[:1].lower() + g.text[1:] if i % 3 == 2 else g.text  # speech often begins in lower case
        plain.segments.append(Segment(g.start, g.end, None, False, said if bare else f"{g.label}: {said}"))
        y.append(name != last)
        last = name
        parts = re.split(r"(?<=[.!?])\s+", g.text, maxsplit=1)
        if len(parts) == 2:
            plain.segments[-1].text = plain.segments[-1].text[: -len(parts[1])].rstrip()
            plain.segments.append(Segment(g.start, g.end, None, False, parts[1]))
            y.append(False)
        if i % 5 in (1, 2):  # speech may break off, or end in a remark
            plain.segments[-1].text = plain.segments[-1].text[:-4] if i % 2 else plain.segments[-1].text + " [noise]"
    for g in plain.segments:
        if m := _LABELLED.match(g.text):
            g.label = m[1]
    as_is = [i == 0 or speaker_name(a.label) != speaker_name(sure[i - 1].label) for i, a in enumerate(sure)]
    x = np.concatenate([features(plain, odds), features(Transcript(sure, t.present, t.language), odds)])
    return x, np.array(y + as_is, dtype=float)


def train(contents: list[str], fillers: dict[str, frozenset[str]]) -> Model:
    """Fit the boundary model on transcripts at hand; learn() does it on all of a table."""
    parsed = [parse(c) for c in contents if c]
    counts: dict[int, list[int]] = {}
    for t in parsed:
        _count_labels(t, counts)
    odds = _odds(counts)
    xs, ys = zip(*[cases(t, counts, odds) for t in parsed]) if parsed else ((), ())
    x, y = (np.concatenate(xs), np.concatenate(ys)) if sum(map(len, ys)) else _NO_CASES
    return Model(odds, BoostedTrees(bins=BINS).fit(x, y), fillers)


def learn(items: DataFrame, text_col: str) -> Model:
    """The model from all transcripts, whole; copies of one text count once.

    The labels' odds are counts over the corpus, at most BUCKETS rows. The trees are fitted on every case: the edges of the bins are exact
    percentiles of all cases, and what reaches the driver is a row per distinct combination of bins with its number of cases.
    """
    texts = materialise(items.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct(), "p7-texts")
    counted = materialise(corpus_counts(texts, "text"), "p7-counts")
    counts = {r.bucket: [r.n, r.off] for r in counted.filter("bucket is not null").collect()}
    odds, trees = _odds(counts), BoostedTrees(bins=BINS)
    names = [f"x{j}" for j in range(FEATURES)]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 256):
                xs, ys = zip(*[cases(parse(x), counts, odds) for x in batch["text"].iloc[s : s + 256]])
                yield pd.DataFrame(np.concatenate(xs), columns=names).assign(y=np.concatenate(ys).astype(np.int64))

    found = materialise(texts.mapInPandas(go, ", ".join(f"{x} double" for x in names) + ", y long"), "p7-cases")
    cuts = found.agg(*[F.percentile(x, [float(p) for p in trees.shares()]).alias(x) for x in names]).first()
    if cuts[0] is None:
        return Model(odds, trees.fit(*_NO_CASES), _fillers(counted))
    edges = [np.unique(c) for c in cuts]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # five bits a feature
            bins = binned(batch[names].to_numpy(), edges).astype(np.int64)
            yield pd.DataFrame({"bins": (bins << (5 * np.arange(FEATURES))).sum(1), "y": batch["y"]})

    rows = found.mapInPandas(pack, "bins long, y long").groupBy("bins").agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("bins")
    bins = (rows["bins"].to_numpy()[:, None] >> (5 * np.arange(FEATURES))) & 31
    return Model(odds, trees.fit_counted(edges, bins, rows["n"].to_numpy(float), rows["y"].to_numpy(float)), _fillers(counted))


def clean_words(text: str, fillers: frozenset[str]) -> list[str]:
    """The pieces of a text without sound remarks, hesitations and listening sounds."""
    out = []
    for p in _PIECE.findall(_REMARK.sub(" ", text)):
        bare = _EDGE.sub("", p).lower()
        parts = [x for x in re.split(r"\.\.\.|…|—", bare) if x]
        if parts and all(_EDGE.sub("", x) in fillers for x in parts):
            continue
        out.append(p)
    return out


def turns(t: Transcript, boundary: np.ndarray, fillers: frozenset[str]) -> list[tuple[int, str, int, float | None, str]]:
    """(turn_no, speaker, n_words, start, text) of a transcript, given the boundary decisions of its segments."""
    merged: list[list] = []
    speaker = ""
    for g, new in zip(t.segments, boundary):
        text = g.text
        if g.label:
            name = speaker_name(g.label)
            if g.certain or new or name == speaker or not speaker:
                speaker = name
                if not g.certain:
                    text = text[text.index(g.label) + len(g.label) :].lstrip(" :-–—")
        words = clean_words(text, fillers)
        if not any(_WORDLIKE.search(w) for w in words):
            continue
        if merged and merged[-1][0] == speaker:
            merged[-1][1].extend(words)
        else:
            merged.append([speaker, words, g.start])
    return [(k, s, sum(bool(_WORDLIKE.search(w)) for w in words), at, " ".join(words)) for k, (s, words, at) in enumerate(merged, 1)]


def training_sample(items: DataFrame, text_col: str, at_most: int = TRAIN_TRANSCRIPTS) -> list[str]:
    """For trials by hand: at most `at_most` different transcripts, chosen by a hash of their text, the same ones on every run; TRAIN_CHARS of each."""
    texts = items.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    chosen = hash_sample(texts.select("h").distinct(), F.col("h"), at_most // 2)  # copies of one text count once
    some = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first(F.substring("text", 1, TRAIN_CHARS)).alias("text"))  # at most `at_most` hashes
    return sorted(r.text for r in some.collect())


def speaker_turns(items: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, turn_no, speaker, n_words, start_seconds, text) of the transcripts.

    Null and empty contents and transcripts without speech give no turn. Speech before any label has the speaker ''.
    Cues with equal start keep their order in the file. Repeated rows give repeated turns; further columns are not read.
    """
    rows = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    cols = ["id", "turn_no", "speaker", "n_words", "start_seconds", "text"]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 256):
                part = batch.iloc[s : s + 256]
                parsed = [parse(x) for x in part["text"]]
                x = [features(t, model.odds) for t in parsed]
                p = model.trees.probability(np.concatenate(x)) if x else np.zeros(0)
                out, k = [], 0
                for i, t in zip(part["id"], parsed):
                    b = p[k : k + len(t.segments)] >= 0.5
                    k += len(t.segments)
                    out.extend((i, *row) for row in turns(t, b, model.fillers[t.language]))
                yield pd.DataFrame(out, columns=cols)

    return rows.mapInPandas(go, f"id {id_type}, turn_no int, speaker string, n_words int, start_seconds double, text string").withColumnRenamed("id", id_col)
