"""Problem 6: mixed timestamp texts to UTC microseconds.

Every text is turned into a shape mask (digits to 9, letters to A) on the JVM. A mask fixes the
place of every field, so each distinct mask is mapped to a parser once per worker process and all
its texts are cut at the same offsets with numpy, then moved to UTC through zone transition tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.zones import ABBREVIATIONS, database_version, local_to_utc

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_ZONE = r"(?P<z> ?A| ?[+-]99(?::?99)?(?:\[[A9/_+-]+\])?| A+(?:/[A9_+-]+)+| A+|A\[[A9/_+-]+\])?"
_CLOCK = r"(?P<h>99):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_CLOCK12 = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99))?(?: ?(?P<ap>AA))?"
#: Shapes of a whole text, matched against its mask; group spans give the field offsets.
SHAPES = [
    ("iso", re.compile(rf"(?P<y>9999)-(?P<mo>99)-(?P<d>99)(?:(?P<t>[A ]){_CLOCK}{_ZONE})?")),
    ("compact", re.compile(rf"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<t>A)(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9+))?{_ZONE}")),
    ("mail", re.compile(rf"(?:AAA, ?)?(?P<d>99?) (?P<mon>AAA) (?P<y>9999) {_CLOCK}{_ZONE}")),
    ("named", re.compile(rf"(?P<mon>A{{3,9}}) (?P<d>99?), (?P<y>9999)(?:,? {_CLOCK12}{_ZONE})?")),
    ("slashes", re.compile(rf"(?P<mo>99?)/(?P<d>99?)/(?P<y>9999)(?:,? {_CLOCK12}{_ZONE})?")),
    ("dots", re.compile(rf"(?P<d>99?)\.(?P<mo>99?)\.(?P<y>9999)(?:,? {_CLOCK}{_ZONE})?")),
    ("epoch", re.compile(r"(?P<sign>-?)(?P<e>9{9,10}|9{13}|9{16}|9{19})(?:[.](?P<f>9+))?")),
]
_EPOCH_DIGITS = {9: 0, 10: 0, 13: 3, 16: 6, 19: 9}


@lru_cache(maxsize=65536)
def parser_for(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The shape's name and the offsets of its fields, or None where no shape fits the mask."""
    for name, shape in SHAPES:
        if m := shape.fullmatch(mask):
            return name, {k: m.span(k) for k, v in m.groupdict().items() if v}
    return None


def shape_mask(text: Column) -> Column:
    """Character-class mask of a trimmed text of any length; null for empty ones."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    mask = F.regexp_replace(F.regexp_replace(t, "[0-9]", "9"), "[A-Za-z]", "A")
    return F.when(t != "", mask)


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (codes[:, i].astype(np.int64) - 48)
    return out


def _words(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Lower-case text of a field per row; few distinct values are expected."""
    part = np.ascontiguousarray(codes[:, span[0] : span[1]])
    return np.char.lower(part.view(f"<U{span[1] - span[0]}").ravel())


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1)
    y, m = np.where(ok, y, 2000), np.where(ok, m, 1)
    first = ((y - 1970) * 12 + m - 1).astype("datetime64[M]")
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    return first.astype("datetime64[D]").astype(np.int64) + d - 1, ok & (d <= length)


def _parse_shape(kind: str, at: dict, texts: list[str], zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(micros, valid) of texts that share one mask."""
    n = len(texts)
    codes = np.array(texts).view(np.uint32).reshape(n, -1)
    frac = np.zeros(n, dtype=np.int64)
    if "f" in at:
        a, b = at["f"]
        digits = min(6, b - a)
        frac = _number(codes, (a, a + digits)) * 10 ** (6 - digits)
    if kind == "epoch":
        digits = at["e"][1] - at["e"][0]
        scale = _EPOCH_DIGITS[digits]
        e = _number(codes, (at["e"][0], at["e"][0] + min(digits, 16)))
        micros = e * 10 ** max(0, 6 - scale) if scale < 9 else e
        micros = micros + (frac if scale == 0 else 0)
        return (-micros if "sign" in at else micros), np.ones(n, dtype=bool)
    ok = np.ones(n, dtype=bool)
    if "t" in at:
        sep = codes[:, at["t"][0]]
        ok &= np.isin(sep, [ord("T"), ord("t"), ord(" ")])
    if "mon" in at:
        names = _words(codes, at["mon"])
        month = np.zeros(n, dtype=np.int64)
        for name in np.unique(names):
            full = [i + 1 for i, m in enumerate(MONTHS) if name[:3] == m]
            month[names == name] = full[0] if full else 0
    else:
        month = _number(codes, at["mo"])
    days, exists = _days(_number(codes, at["y"]), month, _number(codes, at["d"]))
    ok &= exists
    h, mi, s = (_number(codes, at[k]) if k in at else np.zeros(n, dtype=np.int64) for k in ("h", "mi", "s"))
    zone_span = at.get("z")
    if "ap" in at:
        half = _words(codes, at["ap"])
        am, pm = half == "am", half == "pm"
        ok &= (am | pm) & (h >= 1) & (h <= 12)
        h = np.where(pm, h % 12 + 12, h % 12)
    ok &= (h <= 23) & (mi <= 59) & (s <= 59)
    local = days * 86400 + h * 3600 + mi * 60 + s
    utc = local.copy()
    if zone_span:
        part = np.ascontiguousarray(codes[:, zone_span[0] : zone_span[1]]).view(f"<U{zone_span[1] - zone_span[0]}").ravel()
        known = np.ones(n, dtype=bool)
    else:
        part, known = zones, np.zeros(n, dtype=bool)
    for z in pd.unique(pd.Series(part)):
        rows = part == z
        utc[rows], good = _to_utc(local[rows], str(z).strip(), bool(known[0]) if n else False)
        ok[rows] &= good
    return utc * 1_000_000 + frac, ok


_FIXED = re.compile(r"([+-])(\d\d):?(\d\d)?(?:\[.*\])?$")


def _to_utc(local: np.ndarray, zone: str, written: bool) -> tuple[np.ndarray, bool]:
    """written: the zone stands in the text, where an unknown one makes the text invalid; a row's unknown zone counts as UTC."""
    if m := _FIXED.fullmatch(zone):
        seconds = int(m[2]) * 3600 + int(m[3] or 0) * 60
        return local - (seconds if m[1] == "+" else -seconds), int(m[2]) <= 18 and int(m[3] or 0) <= 59
    name = zone.split("[")[0] if "[" in zone else zone
    if (minutes := ABBREVIATIONS.get(name.lower())) is not None:
        return local - minutes * 60, True
    moved = local_to_utc(local, name) if name else None
    if moved is None:
        return local, not written
    return moved, True


def parse_batch(texts: pd.Series, zones: pd.Series, masks: pd.Series) -> np.ndarray:
    """Microseconds as float-free object array with None where a text has no instant."""
    out = np.full(len(texts), np.iinfo(np.int64).min, dtype=np.int64)
    codes, distinct = pd.factorize(masks)
    text = texts.to_numpy(dtype=object)
    zone = zones.fillna("UTC").to_numpy(dtype=object)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(distinct) + 1))
    for k, mask in enumerate(distinct):
        plan = parser_for(mask)
        if plan is None:
            continue
        rows = order[bounds[k] : bounds[k + 1]]
        micros, ok = _parse_shape(*plan, list(text[rows]), zone[rows].astype(str))
        out[rows] = np.where(ok, micros, np.iinfo(np.int64).min)
    return out


@F.pandas_udf(T.LongType())
def _micros_udf(texts: pd.Series, zones: pd.Series, masks: pd.Series) -> pd.Series:
    out = parse_batch(texts, zones, masks)
    return pd.Series(pd.array(out, dtype="Int64")).mask(out == np.iinfo(np.int64).min)


def utc_micros(text: Column, zone: Column | None = None) -> Column:
    """Microseconds since 1970 UTC of a time text, null where the text has no instant.

    A text without zone is in `zone`; a null, blank or unknown `zone` is UTC. Null, empty, placeholder, cut-off
    and impossible texts (30 February, 25:61) give null. Digits below a microsecond are cut.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    z = F.lit("UTC") if zone is None else F.coalesce(F.nullif(F.trim(zone), F.lit("")), F.lit("UTC"))
    return _micros_udf(t, z, shape_mask(text))


def normalise(df: DataFrame, text_col: str, zone_col: str | None = None, out: str = "utc_micros") -> DataFrame:
    """df with `out` (BIGINT, null without instant) and `tz_version`; other columns, of any name, are kept as they are.

    An empty table gives an empty one; repeated rows give repeated rows.
    """
    zone = None if zone_col is None else F.col(zone_col)
    return df.withColumns({out: utc_micros(F.col(text_col), zone), "tz_version": F.lit(database_version())})
