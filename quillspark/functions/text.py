"""Column functions on texts; all run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to tell texts apart.
STOPWORDS = """the and for are but not you all can her was one our out day get has him his how man new now old see two who boy did its let put say
she too use this that with have from they will would there their what about which when where your been than them into such could should
these those then""".split()


def terms(text: Column, least: int = 3) -> Column:
    """Lower-case words of letters, digits, _ and, inside, - with `least` characters or more (three at least), without stopwords, with repeats."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_\-]{%d,}[\p{L}\p{N}_]" % (least - 2)), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def topic_keywords(text: Column, most: int = 5) -> Column:
    """The first distinct words of four characters or more that start with a letter and are no part of a mail address."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\S+@\S+", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z][a-z0-9_\-]{3,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS))), 1, most)


def slug(text: Column, most: int = 60) -> Column:
    """Words joined by dashes, at most `most` characters, `untitled` where nothing is left."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s\-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(joined, 1, most), F.lit("")), F.lit("untitled"))


def estimated_tokens(text: Column) -> Column:
    """Characters divided by four, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def cut_to_tokens(text: Column, n: int) -> Column:
    """The first 4 n characters; the empty text for n <= 0."""
    return F.substring(text, 1, 4 * max(0, n))


def digest(text: Column, n: int = 8) -> Column:
    """The first n hex digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def tsv_safe(text: Column) -> Column:
    """Tabs, line ends and NULs as blanks: one field of one line."""
    return F.regexp_replace(text, r"[\t\r\n\x00]+", " ")


def folded(text: Column) -> Column:
    """Lower case with collapsed blanks, for containment tests."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def section_after(text: Column, heading: str) -> Column:
    """The text between a heading of level 2 and the next one; null for none or an empty one."""
    body = F.regexp_extract(text, rf"(?s)(?:^|\n)## {heading}[^\n]*\n(.*?)(?=\n## |\z)", 1)
    return F.nullif(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(""))
