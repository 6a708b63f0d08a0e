"""Problem 10: cutting oversized texts at natural boundaries.

A text is a tree: headed sections, blocks between blank lines (fenced code stays whole), lines and list items,
sentences, words, characters. Sibling subtrees are merged up to the limit; only a node that is itself
above the limit is descended into. Every piece but the first begins with the given overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import TOKENIZER, count, token_starts

_FENCE = re.compile(r"^[ \t]*(```|~~~).*$", re.M)
_HEADINGS = [re.compile(rf"^{'#' * k} ", re.M) for k in range(1, 7)]
_BLOCK = re.compile(r"\n[ \t]*\n\s*?(?=\S|\Z)")
_ITEM = re.compile(r"\n(?=(?:[-*•+]|\d+[.)]) )")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
_WORD = re.compile(r"\s+")
LEVELS = len(_HEADINGS) + 5


def _fences(text: str) -> list[tuple[int, int]]:
    marks = [m.span() for m in _FENCE.finditer(text)]
    return [(a[0], b[1]) for a, b in zip(marks[::2], marks[1::2])]


def _cuts(text: str, start: int, end: int, level: int, fences: list[tuple[int, int]]) -> Iterator[int]:
    """Where the children of a node begin, without its own start."""
    h = len(_HEADINGS)
    if level < h:
        found = (m.start() for m in _HEADINGS[level].finditer(text, start, end))
    else:
        rule = [_BLOCK, _ITEM, _LINE, _SENTENCE, _WORD][level - h]
        found = (m.end() for m in rule.finditer(text, start, end))
    whole = level <= h  # headings and blocks inside code are none
    for at in found:
        if start < at < end:
            if whole:
                k = bisect_left(fences, (at + 1,)) - 1
                if k >= 0 and fences[k][0] < at < fences[k][1]:
                    continue
            yield at


def pack(text: str, size: Callable[[int, int], int], limit: int) -> list[tuple[int, int]]:
    """Adjacent spans that cover the text, each of size <= limit; one character may exceed a limit smaller than it."""
    fences = _fences(text)

    def node(start: int, end: int, level: int) -> list[tuple[int, int]]:
        if size(start, end) <= limit or end - start <= 1:
            return [(start, end)]
        if level == LEVELS:
            return chars(start, end)
        at = [start, *_cuts(text, start, end, level, fences), end]
        if len(at) == 2:
            return node(start, end, level + 1)
        out: list[tuple[int, int]] = []
        for a, b in zip(at, at[1:]):
            for x, y in node(a, b, level + 1):
                if out and size(out[-1][0], y) <= limit:
                    out[-1] = (out[-1][0], y)
                else:
                    out.append((x, y))
        return out

    def chars(start: int, end: int) -> list[tuple[int, int]]:
        out = []
        while start < end:
            lo, hi = start + 1, end
            while lo < hi:  # the longest prefix within the limit
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if size(start, mid) <= limit else (lo, mid - 1)
            out.append((start, lo))
            start = lo
        return out

    return node(0, len(text), 0) if text else []


def split_text(text: str, limit: int, overlap: int, tokenizer: str | None = TOKENIZER) -> list[tuple[int, int, int, int]]:
    """(start, new_from, end, size) of the pieces of a text above the limit; a text within it gives none.

    text[start:new_from] repeats the end of the piece before, text[new_from:end] is new. Without tokenizer the size
    is characters // 4, the project's own estimate. Every piece's size, overlap included, is <= limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if tokenizer is None:
        if len(text) // 4 <= limit:
            return []
        whole = 4 * limit + 3
        spans = pack(text, lambda a, b: b - a, whole - 4 * overlap)
        out = []
        for k, (a, b) in enumerate(spans):
            back = max(0, a - 4 * overlap) if k else a
            out.append((back, a, b, (b - back) // 4))
        return out
    if len(text.encode("utf-8", "replace")) <= limit:
        return []
    starts = token_starts(text, tokenizer)
    if len(starts) <= limit:
        return []
    place = starts.tolist()

    def size(a: int, b: int) -> int:  # tokens that begin in the span, and one that may reach into it
        lo = bisect_left(place, a)
        return bisect_left(place, b) - lo + (lo == len(place) or place[lo] != a)

    room = limit - overlap
    while True:
        out, worst = [], 0
        for k, (a, b) in enumerate(pack(text, size, max(1, room))):
            at = bisect_left(place, a)
            back = place[max(0, at - overlap)] if k and overlap else a
            n = count(text[back:b], tokenizer)
            if n > limit and b - a > 1:
                # cut alone, a span may take a few tokens more than inside the text: give way at the overlap first
                while n > limit and back < a:
                    k_ = bisect_left(place, back) + n - limit
                    k_ = max(k_, bisect_right(place, back))  # tokens of one character share its place
                    back = min(place[k_], a) if k_ < len(place) else a
                    n = count(text[back:b], tokenizer)
                worst = max(worst, n - limit)
            out.append((back, a, b, n))
        if worst <= 0 or room <= 1:
            return out
        room -= worst


_PIECES = "piece_no int, start_pos long, new_from long, end_pos long, size long, piece string"


def split_pieces(docs: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """Pieces (id, piece_no from 1, start_pos, new_from, end_pos, size, piece) of the documents above the limit.

    Positions are characters from 0, ends exclusive; a piece's new part begins at new_from. Null and empty texts and
    texts within the limit give no rows; repeated documents give repeated pieces; further columns are not read.
    Texts too short to exceed the limit are dropped before they reach Python.
    """
    least = 4 * limit + 3 if tokenizer is None else limit
    length = F.length(text_col) if tokenizer is None else F.octet_length(text_col)
    rows = docs.filter(length > least).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                for k, (back, a, b, n) in enumerate(split_text(text, limit, overlap, tokenizer), 1):
                    out.append((i, k, back, a, b, n, text[back:b]))
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=["id", "piece_no", "start_pos", "new_from", "end_pos", "size", "piece"])
                    out = []
            yield pd.DataFrame(out, columns=["id", "piece_no", "start_pos", "new_from", "end_pos", "size", "piece"])

    return rows.mapInPandas(cut, f"id {id_type}, {_PIECES}").withColumnRenamed("id", id_col)
