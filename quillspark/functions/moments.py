"""Column functions on times. The clock is always an argument, never the machine's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0


def tolerant(text: Column) -> Column:
    """An ISO-8601 text as a timestamp, null for what is none: empty texts, the word null, placeholders."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.trim(text)).try_cast("timestamp")


def age_days(at: Column, now: Column) -> Column:
    """Days between two timestamps as a fraction."""
    return (F.unix_micros(now) - F.unix_micros(at)) / (DAY * 1e6)


def whole_days(at: Column, now: Column) -> Column:
    """Whole days that have passed, rounded down; not the number of midnights between."""
    return F.floor(age_days(at, now)).cast("bigint")


def recency(at: Column, now: Column, half_life_days: float = 90.0) -> Column:
    """1 now, a half after half_life_days; times to come count as now."""
    return F.exp(-F.greatest(F.lit(0.0), age_days(at, now)) * F.lit(0.6931471805599453) / half_life_days)


def stamp_of(name: Column) -> Column:
    """The time in a file name like 2026-04-15T102233Z.json, null where there is none."""
    s = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}T\d{6}Z)", 1)
    return F.when(s != "", F.to_timestamp(F.regexp_replace(s, r"(\d{2})(\d{2})(\d{2})Z$", "$1:$2:$3Z")))
