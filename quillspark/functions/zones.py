"""Zone transition tables: arrays of UTC instants and offsets, searched by whole columns at once.

A table is derived from the time zone database once per process and zone. Its version is
part of the operator's output, so that a re-run under newer rules can be told apart.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np

FIRST, LAST = -2208988800, 4102444800  # 1900-01-01 and 2100-01-01 in seconds
STEP = 7 * 86400

# Offsets in minutes of the abbreviations that mail programs and calendars write.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}


@lru_cache(maxsize=1)
def database_version() -> str:
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except Exception:
        try:
            with open("/usr/share/zoneinfo/tzdata.zi") as f:
                return f.readline().split()[-1]
        except OSError:
            return "unknown"


def _offset(zone: ZoneInfo, sec: int) -> int:
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=sec)
    return int(at.astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=1024)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants, offsets): offsets[i] holds from instants[i - 1] until before instants[i]. None: no such zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:
        return None
    at, offsets = [], [_offset(zone, FIRST)]
    lo = FIRST
    while lo < LAST:
        hi = min(lo + STEP, LAST)
        if (new := _offset(zone, hi)) != offsets[-1]:
            a, b = lo, hi
            while b - a > 1:
                mid = (a + b) // 2
                if _offset(zone, mid) == offsets[-1]:
                    a = mid
                else:
                    b = mid
            at.append(b)
            offsets.append(new)
        lo = hi
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def local_to_utc(local: np.ndarray, name: str) -> np.ndarray | None:
    """Local seconds to UTC seconds. Twice-occurring times: the earlier instant; skipped ones: moved on by the gap."""
    found = transitions(name)
    if found is None:
        return None
    at, off = found
    period = np.searchsorted(at + off[:-1], local, side="right")  # first period whose local end lies after `local`
    start = np.concatenate(([np.iinfo(np.int64).min // 2], at)) + off
    before = off[np.maximum(period - 1, 0)]
    return local - np.where(local < start[period], before, off[period])
