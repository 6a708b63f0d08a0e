"""Problem 1: the text a mail's sender wrote, without quotations, signatures and legal text.

Lines are joined to units (wrapped lines, list items). The dictionaries are a mail's thread ancestors, both what it quotes
itself and the units of earlier mails of its thread, and the closings that senders put under many mails, learned over all
mails as unit shapes with their number of mails. A unit that compresses abnormally well with a dictionary is flagged, and
dropped only if its words also overlap the dictionary exactly; quotation marks, introductions, header blocks and
sign-offs are read from the layout. Everything else is kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import blake2b
from operator import and_
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.plans.session import materialise

#: A shape is a closing if at least so many mails have it.
LEAST_MAILS = 3
#: Bytes that one compression window reaches back; longer dictionaries are cut into windows that overlap by half.
WINDOW = 32_000

# Words of sign-offs, as senders write them before their names.
CLOSINGS = """best|best regards|best wishes|kind regards|warm regards|regards|sincerely|yours sincerely|yours|cheers|thanks|many thanks|
thank you|thx|talk soon|take care|all the best|rgds|br|mit freundlichen grüßen|freundliche grüße|viele grüße|beste grüße|herzliche grüße|
liebe grüße|schöne grüße|gruß|grüße|lg|vg|mfg|cordialement|bien cordialement|bien à vous|à bientôt|amicalement|salutations|un saludo|
saludos|saludos cordiales|gracias y un saludo|un abrazo|atentamente|groet|groeten|met vriendelijke groet|hartelijke groet|mvg""".replace("\n", "").split("|")
# What devices, lists and lawyers put under mails, where too few mails are at hand to learn it.
SEED_CLOSINGS = [
    "Sent from my phone", "Sent from my tablet, please excuse typos", "Sent from my mobile device", "Get the mobile mail app",
    "Envoyé de mon mobile", "Enviado desde mi móvil", "Von meinem Handy gesendet", "Von unterwegs gesendet", "Gesendet von meinem Mobilgerät",
    "Verstuurd vanaf mijn telefoon", "Please consider the environment before printing this mail.",
    "This message is confidential and intended solely for the addressee. If you got it by mistake, tell us and delete every copy.",
    "Diese Nachricht ist vertraulich und nur für den Empfänger bestimmt. Wenn Sie sie irrtümlich erhalten haben, löschen Sie sie bitte.",
    "Ce message est confidentiel et réservé à son destinataire. En cas d'erreur, merci de le supprimer.",
    "Este mensaje es confidencial y va dirigido solo a su destinatario. Si lo ha recibido por error, bórrelo.",
    "accepts no liability for views stated here that are not those of the company.",
    "You get this message because you follow the list. To leave the list, open your settings.",
    "This mail came from outside. Do not open links you do not know.",
]

_QUOTE = re.compile(r"^[ \t]{0,3}(?:>(?!=\s?\d)|\|(?=[ \t]|$))")  # ">= 5 ms" is no quotation
_INDENT = re.compile(r"^(?: {4}|\t)\s*\S")
_KEY = r"(?:From|Sent|Date|To|Cc|Bcc|Subject|Reply-To|Von|Gesendet|Datum|An|Kopie|Betreff|De|Envoyé|À|Objet|Para|Enviado|Asunto|Fecha|Van|Verzonden|Aan|Onderwerp|Da|A)"
_HEAD = re.compile(rf"^\s*\*?{_KEY}\*?\s?:\*?(?:\s|$)", re.I)
_FIRST = re.compile(r"^\s*\*?(?:From|Von|De|Van|Da)\*?\s?:\*?\s+\S", re.I)
_MARKER = re.compile(r"^\s*-{2,}\s*(?:[^\W\d_]|[ '])+\s*-{2,}\s*$")
_RULE = re.compile(r"^\s*(?:[-_=*~#+.·—–]\s?){2,}\s*$")
_WHEN = r"(?:\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}\.? [^\W\d_]{3,9}\.?,? \d{4}|[^\W\d_]{3,9}\.? \d{1,2},? \d{4})"
_INTRO_END = re.compile(r"(?:wrote|writes|said|schreef|schrieb(?:\s[^:]{1,90})?|geschrieben|escribió|a écrit|ha scritto|(?:wrote|schreef|schrieb) (?:on|op|am)\s.{6,40})\s?:$", re.I)
_DATED = re.compile(rf"^(?:[^\W\d_]{{2,4}},? )?{_WHEN},? (?:(?:at|um|à|a las|om) )?\d{{1,2}}:\d\d(?: ?[AP]M)?,? .{{1,90}}:$")
_PS = re.compile(r"^\s*(?:P\.? ?S\.?|P\.? ?D\.?|N\.? ?B\.?)\s?[:.\-–]", re.I)
_NAMELINE = re.compile(r"^\s*(?:[-–—/~]\s?)?[^\W\d_][\w'’.-]*(?:[ ][^\W\d_][\w'’.-]*){0,4}\s*$")
_CLOSING = re.compile(r"^\s*(" + "|".join(sorted(map(re.escape, CLOSINGS), key=len, reverse=True)) + r")\s*[,.!–-]*\s*(.*)$", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def shape(text: str) -> str:
    """A unit with its names and numbers masked and its line breaks undone."""
    s = re.sub(r"\s+", " ", text.strip())
    s = re.sub(r"\d+", "9", s)
    return re.sub(r"(?<=[ ])[A-ZÀ-Þ][\w’'-]*|^[A-ZÀ-Þ][a-zà-ÿ’'-]+(?= accepts| \w+ no)", "X", s)


def _lines(content: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in content.split("\n")]


def _intro(lines: list[str], i: int) -> int:
    """How many lines from i on introduce a quotation: 0, 1 or 2."""
    s = lines[i].strip()
    for n in (1, 2):
        if n == 2:
            if i + 1 >= len(lines) or not lines[i + 1].strip() or _QUOTE.match(lines[i + 1]):
                return 0
            s = f"{s} {lines[i + 1].strip()}"
        if not s.endswith(":"):
            continue
        if not ((_INTRO_END.search(s) and re.search(r"\d{1,2}:\d\d", s)) or _DATED.match(s)):
            continue
        return n
    return 0


def structure(lines: list[str]) -> tuple[list[str], str]:
    """A kind per line (head, quote, intro, blank, text) and the sender's name; text is what the layout doesn't explain."""
    n = len(lines)
    kind = ["text"] * n
    sender = ""
    i = 0
    while i < n and (not lines[i].strip() or lines[i].startswith("# ") or _HEAD.match(lines[i]) or (i and kind[i - 1] == "head" and lines[i][:1] in " \t")):
        if not lines[i].strip():
            kind[i] = "blank"
            if any(k == "head" and _HEAD.match(x) for k, x in zip(kind[:i], lines[:i])):
                break
        else:
            if _HEAD.match(lines[i]) and not any(_HEAD.match(x) for x in lines[:i]) and not _FIRST.match(lines[i]):
                break  # a first line like "To: whoever ..." is no header
            kind[i] = "head"
            if m := re.match(r"^\s*\*?(?:From|Von|De|Van)\*?\s?:\*?\s+([^<\n]*)", lines[i]):
                sender = sender or m[1].strip(' "')
        i += 1
    indented = False
    while i < n:
        s = lines[i].strip()
        if not s:
            kind[i] = "blank"
            i += 1
            continue
        if _QUOTE.match(lines[i]):
            kind[i] = "quote"
            i += 1
            continue
        if indented and _INDENT.match(lines[i]):
            kind[i] = "quote"
            i += 1
            continue
        indented = False
        j = i
        if _MARKER.match(lines[i]) or _RULE.match(lines[i]):
            j = next((k for k in range(i + 1, min(n, i + 4)) if lines[k].strip()), n)
        elif s.endswith(":") and len(s) < 80:  # words that introduce a forwarded mail's header lines
            j = next((k for k in range(i + 1, min(n, i + 4)) if lines[k].strip()), i)
            j = j if j < n and _FIRST.match(lines[j]) else i
        if j < n and _FIRST.match(lines[j]) and sum(bool(_HEAD.match(x)) for x in lines[j : j + 5]) >= (3 if j == i else 2):
            kind[i:] = ["quote" if x.strip() else "blank" for x in lines[i:]]
            break
        if _MARKER.match(lines[i]) and re.search(r"forward|original|weitergeleitet|ursprünglich|transféré|reenviado|origine", s, re.I):
            kind[i:] = ["quote" if x.strip() else "blank" for x in lines[i:]]
            break
        if k := _intro(lines, i):
            nxt = next((x for x in lines[i + k :] if x.strip()), "")
            kind[i : i + k] = ["intro"] * k
            i += k
            indented = bool(_INDENT.match(nxt))
            if nxt and not indented and not _QUOTE.match(nxt):  # an unmarked quotation reaches to the end
                kind[i:] = ["quote" if x.strip() else "blank" for x in lines[i:]]
                break
            continue
        i += 1
    return kind, sender


def units(lines: list[str], kind: list[str]) -> list[list[int]]:
    """Runs of text lines that were one line before wrapping."""
    out: list[list[int]] = []
    for i, k in enumerate(kind):
        if k != "text":
            continue
        if out and out[-1][-1] == i - 1 and len(lines[i - 1].rstrip()) >= 45 and len(lines[i - 1].rstrip()) + 1 + len(lines[i].split(" ")[0]) > 66 and not _ITEM.match(lines[i]) and not ((m := _CLOSING.match(lines[i])) and not m[2].strip(" ,.–-")):
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _shingles(text: str, n: int = 3) -> set[tuple[str, ...]]:
    w = [x.lower() for x in _WORD.findall(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


class Dictionary:
    """A compression dictionary of any length with the exact words behind it."""

    def __init__(self, texts: list[str]):
        data = "\n".join(texts).encode("utf-8", "replace")
        self.windows = [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW // 2), WINDOW // 2)] if data else []
        self.shingles: set[tuple[str, ...]] = set()
        for t in texts:
            self.shingles |= _shingles(t)

    def repeats(self, text: str, gain: float = 0.45, overlap: float = 0.7) -> bool:
        """Whether text compresses abnormally well with a window of this dictionary and its words do overlap it."""
        raw = text.encode("utf-8", "replace")
        if not self.windows or len(raw) < 4:
            return False
        plain = len(zlib.compress(raw, 6))
        for window in self.windows:
            c = zlib.compressobj(6, zdict=window)
            if len(c.compress(raw)) + len(c.flush()) <= (1 - gain) * plain + 6:
                own = _shingles(text)
                return sum(x in self.shingles for x in own) >= overlap * len(own)
        return False


def new_lines(content: str, closings: Dictionary) -> list[int]:
    """Numbers, from 1, of the non-blank lines that the sender newly wrote."""
    lines = _lines(content)
    kind, sender = structure(lines)
    quoted = [re.sub(r"^[>|\s]+", "", x) for x, k in zip(lines, kind) if k == "quote"]
    ancestors = Dictionary([" ".join(quoted)] if quoted else [])
    runs = units(lines, kind)
    given = {x.lower() for x in re.findall(r"[^\W\d_][\w'’-]*", sender)}
    drop: set[int] = set()
    signed = False
    n = len(runs)
    body = 0  # units of new text so far

    def gap_before(k: int) -> bool:
        i = runs[k][0]
        return i == 0 or kind[i - 1] != "text"

    def last_of_block(k: int) -> bool:
        i = runs[k][-1]
        return i + 1 >= len(lines) or kind[i + 1] != "text"

    k = 0
    while k < n:
        i = runs[k][0]
        text = "\n".join(lines[j] for j in runs[k])
        s = text.strip()
        block = next((m for m in range(k, n) if last_of_block(m)), n - 1)
        if _PS.match(s):
            signed = False
            body += 1
            k = block + 1
            continue
        if _RULE.match(s):
            # a rule opens a signature or legal text; the lines of its block go with it
            drop.update(range(k, block + 1))
            signed = True
            k = block + 1
            continue
        c = _CLOSING.match(s)
        if c and len(runs[k]) == 1 and (gap_before(k) or body):
            rest = c[2].strip(" ,.–-")
            names = [x.lower() for x in re.findall(r"[^\W\d_][\w'’-]*", rest)]
            named = not rest or (len(names) <= 5 and _NAMELINE.match(rest) and (not given or set(names) & given or len(names) <= 4 and rest.istitle()))
            tail = all(len(lines[runs[m][0]].split()) <= 12 for m in range(k + 1, block + 1))
            if named and tail and (rest or not last_of_block(k) or body):
                drop.update(range(k, block + 1))
                signed = True
                k = block + 1
                continue
        if closings.repeats(shape(text)) and (body or k + 1 < n or len(_WORD.findall(s)) > 3):
            drop.add(k)
            if len(s.split()) <= 6 and all(len(lines[runs[m][0]].split()) <= 8 for m in range(k + 1, block + 1)):
                drop.update(range(k, block + 1))  # the rest of a signature
                k = block
            k += 1
            continue
        if body and _NAMELINE.match(s) and len(runs[k]) == 1 and (gap_before(k) or last_of_block(k)) and not s.endswith(","):
            names = [x.lower() for x in re.findall(r"[^\W\d_][\w'’-]*", s)]
            initial = len(names) == 1 and len(names[0]) == 1 and s.endswith(".")
            marked = s[0] in "-–—/~" and len(names) <= 3
            known = bool(given & set(names)) and len(names) <= 4
            alone = not given and len(names) <= 3 and not s.endswith((".", "!", "?", ":")) and s[0].isupper()
            if not gap_before(k):  # right under the text only the sender's own name is a sign-off
                initial = marked = alone = False
                known = known and not s.endswith((".", "!", "?"))
            if initial or marked or known or (alone and (last_of_block(k) or block - k <= 5)):
                drop.update(range(k, block + 1))
                signed = True
                k = block + 1
                continue
        if len(s) >= 40 and ancestors.repeats(re.sub(r"\s+", " ", s), overlap=0.9):
            drop.add(k)
            k += 1
            continue
        body += 1
        k += 1
    return [j + 1 for k, r in enumerate(runs) if k not in drop for j in r]


def _shapes(content: str) -> list[tuple[str, bool]]:
    """The shapes of a mail's units outside quotations, in order, and whether each is a postscript."""
    lines = _lines(content)
    kind, _ = structure(lines)
    texts = ["\n".join(lines[i] for i in r) for r in units(lines, kind)]
    return [(shape(x), bool(_PS.match(x.strip()))) for x in texts]


def _words_of(x: str) -> int:
    return x.count(" ") + 1


def _shape_key(x: str) -> int:
    return int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "big", signed=True)


def _often(mails: DataFrame, least: int) -> frozenset[int]:
    """Keys of the shapes that `least` mails have: only keys are shuffled, and no more come back than that many mails can have in common."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c: Counter[int] = Counter()
            for content in batch["text"]:
                c.update({_shape_key(x) for x, _ in _shapes(content) if _words_of(x) >= 4})
            yield pd.DataFrame({"key": list(c), "n": list(c.values())})

    counted = mails.mapInPandas(go, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return frozenset(r["key"] for r in counted.filter(F.col("n") >= least).select("key").collect())


def _closing_counts(mails: DataFrame, known: frozenset[int]) -> DataFrame:
    """(shape, n, n_before): of the `known` shapes the mails that have them, and those where a longer unknown unit follows."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list[int]] = {}
            for content in batch["text"]:
                before, seen = False, set()
                for x, ps in reversed(_shapes(content)):
                    if _words_of(x) >= 4 and _shape_key(x) in known:
                        if x not in seen:
                            seen.add(x)
                            c = out.setdefault(x, [0, 0])
                            c[0] += 1
                            c[1] += before
                    elif not ps and _words_of(x) >= 9 and not _HEAD.match(x):
                        before = True
            yield pd.DataFrame([(k, *v) for k, v in out.items()], columns=["shape", "n", "n_before"])

    counted = mails.mapInPandas(go, "shape string, n long, n_before long")
    return counted.groupBy("shape").agg(F.sum("n").alias("n"), F.sum("n_before").alias("n_before"))


def learn_closings(mails: DataFrame, text_col: str, share: float = 0.0004, amid: float = 0.15) -> list[str]:
    """Shapes that stand under many mails: those in LEAST_MAILS mails and in `share` of all, without those that new text follows in
    more than `amid` of their mails, the rarer ones first. Counted over all mails; `share` bounds how many there can be."""
    m = mails.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    known = _often(m, max(LEAST_MAILS, int(m.count() * share)))
    rows = _closing_counts(m, known).filter(F.col("n_before") <= amid * F.col("n")).orderBy("n", F.desc("shape")).collect()
    return [r["shape"] for r in rows]


_SUBJECT = re.compile(r"(?mi)^\s*\*?(?:Subject|Betreff|Objet|Asunto|Onderwerp|Oggetto)\*?\s?:\*?[ \t]*(.*)$")
_REPLY = re.compile(r"^(?:(?:re|fwd?|aw|wg|tr|rv|sv|antw)\s*(?:\[\d+\])?\s*:\s*)+", re.I)
#: A unit is sought among its ancestors if it has so many characters.
LEAST_UNIT = 40


def thread_of(content: str) -> str | None:
    """The subject of a mail without marks of reply, which names its thread; none without subject."""
    m = _SUBJECT.search(content[: content.find("\n\n", 200) if len(content) > 200 else None])
    return _REPLY.sub("", m[1].strip()).strip().lower() or None if m else None


#: Share of a unit's word triples that an ancestor must have.
OVERLAP = 0.9


@F.pandas_udf(T.ArrayType(T.LongType()))
def _marks(thread: pd.Series, unit: pd.Series) -> pd.Series:
    """A number per different word triple of a unit within its thread; triples that share one by chance only add candidates."""
    return pd.Series([list({(crc32(t.encode()) << 31) ^ crc32(" ".join(x).encode()) for x in _shingles(u)}) for t, u in zip(thread, unit)])


@F.pandas_udf(T.BooleanType())
def _repeats(unit: pd.Series, ancestor: pd.Series) -> pd.Series:
    return pd.Series([Dictionary([a]).repeats(u, overlap=OVERLAP) for u, a in zip(unit, ancestor)], dtype=bool)


def _earliest(mails: DataFrame) -> DataFrame:
    """Of the mails o (at, same, id) of each class `cls` five at most: whichever mail is left out by its content and its id, the earliest of
    the others is among them."""
    differ = lambda k, x: F.col(f"o.{k}") != F.col(f"{x}.{k}")
    least = lambda *c: F.min(F.when(reduce(and_, c), F.col("o")))
    one = mails.groupBy("cls").agg(F.min("o").alias("e"))
    two = mails.join(one.hint("merge"), "cls").groupBy("cls").agg(F.min("e").alias("e"), least(differ("same", "e")).alias("f"), least(differ("id", "e")).alias("g"))
    more = [least(differ("same", "e"), differ("id", "f")), least(differ("id", "e"), differ("same", "g"))]
    all_ = mails.join(two.hint("merge"), "cls").groupBy("cls").agg(*[F.min(x).alias(x) for x in "efg"], *[c.alias(f"m{k}") for k, c in enumerate(more)])
    return all_.select("cls", F.explode(F.array_distinct(F.array("e", "f", "g", "m0", "m1"))).alias("o")).filter("o is not null")


def ancestor_lines(mails: DataFrame, id_col: str, text_col: str, at_col: str) -> DataFrame:
    """(id, line_no) of the lines whose unit repeats one of an earlier mail of the same thread, whichever of them that is.

    Equal units of a thread are one class, of which the five mails of `_earliest` stand for all, so a thread with a third of all mails
    is aggregated. A class that repeats another has all but a tenth of its word triples: one of any tenth and one more is among them, and the
    rarest of the thread are taken. The earliest class that has such a triple is tried first; only what it doesn't
    settle meets all others. The same test as for quotations decides. Deliveries of one mail (equal id or equal content) are no
    ancestors of each other and count from the first of them (of equal content, then of equal id); without time or
    subject there are none.
    """
    rows = mails.filter(F.col(text_col).isNotNull() & F.col(at_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.unix_micros(at_col).alias("at"))
    id_type = rows.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, content, at in zip(batch["id"], batch["text"], batch["at"]):
                thread = thread_of(content)
                if thread is None:
                    continue
                lines = _lines(content)
                kind, _ = structure(lines)
                same = _shape_key(content)
                for r in units(lines, kind):
                    t = re.sub(r"\s+", " ", " ".join(lines[k] for k in r)).strip()
                    if len(t) >= LEAST_UNIT:
                        out.append((thread, at, same, i, r[0] + 1, r[-1] + 1, t))
            yield pd.DataFrame(out, columns=["thread", "at", "same", "id", "first", "last", "unit"])

    found = materialise(rows.mapInPandas(split, f"thread string, at long, same long, id {id_type}, first int, last int, unit string"), "p1-units")
    shared = found.groupBy("thread").agg((F.min("same") < F.max("same")).alias("a"), (F.min("id") < F.max("id")).alias("b"), (F.min("at") < F.max("at")).alias("c")).filter("a and b and c")
    live = found.join(shared.select("thread").hint("merge"), "thread", "left_semi").withColumn("cls", F.unhex(F.md5(F.concat_ws("\n", "thread", "unit"))))
    sent = live.select("same", "id", "at").distinct()
    sent = sent.select("same", "id").distinct().join(sent.groupBy("same").agg(F.min("at").alias("at")).hint("merge"), "same")
    sent = sent.join(sent.groupBy("id").agg(F.min("at").alias("sent")).hint("merge"), "id").select("same", "id", F.col("sent").alias("at"))
    live = live.drop("at").join(sent.hint("merge"), ["same", "id"])
    live = materialise(live.select("cls", F.struct("at", "same", "id").alias("o"), "first", "last", "thread", "unit"), "p1-live")
    places = live.select("cls", "o", "first", "last").distinct()
    classes = live.groupBy("cls").agg(F.first("thread").alias("thread"), F.first("unit").alias("unit"), F.min("o.at").alias("since"), F.max("o.at").alias("until"))
    classes = materialise(classes, "p1-classes")
    marked = materialise(classes.select("cls", "since", "until", F.explode(_marks("thread", "unit")).alias("mark")), "p1-marks")
    oldest = materialise(_earliest(live.select("cls", "o").distinct()), "p1-oldest")

    def repeated(pairs: DataFrame) -> DataFrame:
        """The places of units of a class u that repeat a class a."""
        text = classes.select("cls", "unit")
        p = pairs.distinct().join(text.withColumnsRenamed({"cls": "u", "unit": "uu"}).hint("merge"), "u").join(text.withColumnsRenamed({"cls": "a", "unit": "ua"}).hint("merge"), "a")
        p = p.filter(_repeats("uu", "ua")).select("u", F.col("a").alias("cls"))
        before = _earliest(p.join(oldest.hint("merge"), "cls").select(F.col("u").alias("cls"), "o").distinct()).withColumnRenamed("o", "b")
        return places.join(before.hint("merge"), "cls").filter("b.at < o.at and b.same <> o.same and b.id <> o.id").select(*places.columns).distinct()

    counted = marked.groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("since", "cls")).alias("first"))
    rarest = marked.join(counted.hint("merge"), "mark").groupBy("cls", "until").agg(F.array_sort(F.collect_list(F.struct("n", "mark", "first"))).alias("m"))
    few = F.floor(F.size("m") * (1 - OVERLAP) + 1e-6) + 1
    probes = rarest.select(F.col("cls").alias("u"), "until", F.explode(F.slice("m", F.lit(1), few.cast("int"))).alias("p")).select("u", "until", "p.*").filter("n > 1")
    probes = materialise(probes, "p1-probes")
    itself = classes.filter("since < until").select(F.col("cls").alias("u"), F.col("cls").alias("a"))
    old = probes.filter("first.since < until and first.cls <> u").select("u", F.col("first.cls").alias("a"))
    settled = materialise(repeated(itself.unionByName(old)), "p1-settled")
    open_ = places.join(settled.hint("merge"), places.columns, "left_anti").select(F.col("cls").alias("u")).distinct()
    rest = probes.join(open_.hint("merge"), "u", "left_semi").select("u", "until", "mark").join(marked.select(F.col("cls").alias("a"), "since", "mark").hint("merge"), "mark")
    rest = rest.filter("a <> u and since < until").select("u", "a")
    both = settled.unionByName(repeated(rest))
    return both.select(F.col("o.id").alias(id_col), F.explode(F.sequence("first", "last")).alias("line_no")).distinct()


@lru_cache(maxsize=2)
def _dictionary(shapes: tuple[str, ...]) -> Dictionary:
    return Dictionary([shape(x) for x in SEED_CLOSINGS] + list(shapes))


def written_lines(mails: DataFrame, id_col: str, text_col: str, closings: list[str], at_col: str | None = None) -> DataFrame:
    """(id, line_no, line) of the lines that the senders newly wrote; blank lines are counted but not listed. With `at_col`, the time of
    a mail, lines that repeat earlier mails of its thread are not new either.

    Null and empty contents and mails that only quote give no rows. Repeated rows give repeated lines; further columns
    are not read.
    """
    rows = mails.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shapes = tuple(closings)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = _dictionary(shapes)
        for batch in batches:
            out = []
            for i, content in zip(batch["id"], batch["text"]):
                lines = _lines(content)
                out.extend((i, k, lines[k - 1]) for k in new_lines(content, d))
            yield pd.DataFrame(out, columns=["id", "line_no", "line"])

    out = rows.mapInPandas(go, f"id {id_type}, line_no int, line string").withColumnRenamed("id", id_col)
    return out if at_col is None else out.join(ancestor_lines(mails, id_col, text_col, at_col).hint("merge"), [id_col, "line_no"], "left_anti")
