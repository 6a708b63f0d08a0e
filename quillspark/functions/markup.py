"""Column functions on front matter, inline provenance comments, fenced blocks and flags; all run on the JVM but the accent folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shapes of a session, of an instant and of a source that a reference may name.
SESSION = r"^[0-9a-f]{8}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
CANONICAL = r"^(?:kb#\S(?:[^\n]*\S)?|mem://[\w-]+|art://[\w-]+|https?://\S+)$"


@F.pandas_udf(T.StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))


def normalised(text: Column) -> Column:
    """Compatibility-decomposed, without accents and what is no ASCII; lower case; everything but a-z, 0-9 and blanks becomes a blank; blanks
    collapse. Texts that are ASCII never leave the JVM."""
    odd = text.rlike(r"[^\x00-\x7F]")
    flat = F.when(odd, _unaccented(F.when(odd, text))).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(flat), r"[^a-z0-9\s]", " "), r"\s+", " "))


def header_fields(text: Column) -> Column:
    """MAP<STRING, STRING> of the top-level lines `key: value` of a text that begins with a block between `---` lines; null without one.

    Values lose surrounding quotes; of repeated keys the first counts.
    """
    block = F.nullif(F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1), F.lit(""))
    line = F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$")
    keys, values = F.regexp_extract_all(block, line, F.lit(1)), F.regexp_extract_all(block, line, F.lit(2))
    plain = F.transform(values, lambda v: F.regexp_replace(F.trim(v), r"""^(["'])(.*)\1$""", "$2"))
    names = F.array_distinct(keys)
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(plain, F.array_position(keys, k).cast("int") - 1)))


def header_list(text: Column, key: str) -> Column:
    """ARRAY<STRING> under a top-level key: `key: [a, b]` or lines `- a` below it; null where the key is missing."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?\n)---", 1)
    inline = F.nullif(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1), F.lit(""))
    below = F.nullif(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1), F.lit(""))
    items = F.when(inline.isNotNull(), F.split(inline, ",")).when(below.isNotNull(), F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1)))
    return F.filter(F.transform(items, lambda v: F.regexp_replace(F.trim(v), r"""^(["'])(.*)\1$""", "$2")), lambda v: v != "")


def header_map(text: Column, key: str) -> Column:
    """MAP<STRING, STRING> of the indented `name: value` lines below a top-level key; empty where there are none."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?\n)---", 1)
    below = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]+[\w-]+:.*\n?)+)", 1)
    line = F.lit(r"(?m)^[ \t]+([\w-]+):[ \t]*(.*)$")
    keys = F.regexp_extract_all(below, line, F.lit(1))
    names = F.array_distinct(keys)
    values = F.transform(F.regexp_extract_all(below, line, F.lit(2)), lambda v: F.regexp_replace(F.trim(v), r"""^(["'])(.*)\1$""", "$2"))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(values, F.array_position(keys, k).cast("int") - 1)))


def updated(fields: Column, changes: dict[str, str | None]) -> Column:
    """A field map with keys set, added, or deleted where the new value is None; the others stay as they are."""
    kept = F.map_filter(fields, lambda k, v: ~k.isin(list(changes)))
    new = [F.lit(x) for k, v in changes.items() if v is not None for x in (k, v)]
    return F.map_concat(kept, F.create_map(*new)) if new else kept


def produced_by(text: Column) -> Column:
    """STRUCT<session, query, at, sources> of the first inline comment `<!-- produced_by: k=v, ... -->`; null without one.

    Commas inside `[...]` part sources, not keys; quotes round a value fall off.
    """
    body = F.nullif(F.regexp_extract(text, r"(?s)<!--\s*produced_by:\s*(.*?)\s*-->", 1), F.lit(""))
    one = lambda k: F.regexp_replace(F.trim(F.regexp_extract(body, rf"(?:^|,)\s*{k}=((?:[^,\[]|\[[^\]]*\])*)", 1)), r'^"(.*)"$', "$1")
    listed = F.filter(F.transform(F.split(F.regexp_extract(body, r"(?s)(?:^|,)\s*sources=\[(.*?)\]", 1), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(body.isNotNull(), F.struct(one("session").alias("session"), one("query").alias("query"), one("at").alias("at"), listed.alias("sources")))


def produced_by_errors(p: Column) -> Column:
    """ARRAY<STRING> of what a produced_by struct lacks: session, query, at, sources (none), source (one that isn't canonical)."""
    rules = F.array(
        F.when(~p["session"].rlike(SESSION), "session"), F.when(F.trim(p["query"]) == "", "query"), F.when(~p["at"].rlike(INSTANT), "at"),
        F.when(F.size(p["sources"]) == 0, "sources"), F.when(F.exists(p["sources"], lambda s: ~s.rlike(CANONICAL)), "source"),
    )
    return F.array_compact(rules)


def bare_reference(uri: Column) -> Column:
    """The identity in an `art://` reference, whether or not it repeats the prefix `art-`; null for other references."""
    return F.nullif(F.regexp_extract(uri, r"^art://(?:art-)?([\w-]+)$", 1), F.lit(""))


def flag_state(text: Column) -> Column:
    """absent (null), false, true, or malformed; quotes and blanks around it and its case don't count."""
    t = F.lower(F.regexp_replace(F.trim(text), r"""^["']+|["']+$""", ""))
    return F.when(text.isNull(), "absent").when(t == "true", "true").when(t == "false", "false").otherwise("malformed")


def fenced_blocks(text: Column) -> Column:
    """ARRAY<STRING>: the contents of the blocks between fences of the same kind."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n(.*?)^[ \t]*\1"), F.lit(2))


def without_fences(text: Column) -> Column:
    """A text that is one fenced block as what stands inside; others trimmed only."""
    return F.regexp_replace(F.trim(text), r"(?s)\A(?:```|~~~)[\w-]*\n(.*?)\n?(?:```|~~~)\s*\z", "$1")


def added_lines(diff: Column) -> Column:
    """The lines of a diff without their plus signs; null if a line that isn't blank begins with anything else."""
    lines = F.split(diff, "\n")
    sound = F.forall(lines, lambda x: (F.trim(x) == "") | x.startswith("+"))
    return F.when(sound, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\+", "")), "\n"))


def bad_diff_lines(diff: Column) -> Column:
    """Numbers, from 1, of the non-blank lines of a diff that don't begin with a plus sign."""
    marks = F.transform(F.split(diff, "\n"), lambda x, i: F.when((F.trim(x) != "") & ~x.startswith("+"), i + 1))
    return F.array_compact(marks)


def clean_keywords(words: Column, most: int = 5, longest: int = 32) -> Column:
    """Trimmed, lower case, cut to `longest`, without empty ones, the first `most`; repeats stay."""
    kept = F.filter(F.transform(words, lambda w: F.substring(F.lower(F.trim(w)), 1, longest)), lambda w: w != "")
    return F.slice(kept, 1, most)


def split_keywords(text: Column) -> Column:
    """A comma-separated text as its trimmed parts, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda w: F.trim(w)), lambda w: w != "")


def first_topic(query: Column, topics: list[str]) -> Column:
    """The first of the topics, a list from configuration, that stands in the query as whole words, whatever its case; null for none."""
    import re

    hit = lambda t: F.lower(query).rlike(r"\b" + re.escape(t.lower()) + r"\b")
    return F.coalesce(*[F.when(hit(t), F.lit(t)) for t in topics]) if topics else F.lit(None).cast("string")


def live_reason(hits: Column, topic: Column) -> Column:
    """zero_hit where memory has nothing, else topic_pinned where a topic matches, else null."""
    return F.when(hits == 0, "zero_hit").when(topic.isNotNull(), "topic_pinned")


def strictly_true(text: Column) -> Column:
    """Whether a text says true or yes, whatever its case and the blanks around it; numbers, other words and null don't."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "yes"), F.lit(False))


def reference_error(uri: Column) -> Column:
    """What keeps a text from being an `art://` reference: missing, scheme, empty, long (over 128 characters), shape; null if it is one."""
    body = F.substring(uri, 7, 2**31 - 1)
    return (
        F.when(F.coalesce(F.trim(uri), F.lit("")) == "", "missing").when(~uri.startswith("art://"), "scheme").when(body == "", "empty")
        .when(F.length(body) > 128, "long").when(~body.rlike(r"\A[A-Za-z0-9_-]+\z"), "shape")
    )


def glob_pattern(glob: str) -> str:
    """A path pattern as a regular expression: `*` and `?` stay within a folder, `**/` is any number of folders."""
    import re

    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$"


def literal_type(text: Column) -> Column:
    """integer, number, boolean or null where a text is such a JSON literal, else text; missing for null and empty texts."""
    t = F.trim(text)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "missing").when(t.isin("true", "false"), "boolean").when(t == "null", "null")
        .when(t.rlike(r"\A-?(0|[1-9]\d*)\z"), "integer").when(t.rlike(r"\A-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\z"), "number").otherwise("text")
    )
