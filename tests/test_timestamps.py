import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions.zones import local_to_utc
from quillspark.operators.timestamps import normalise, parse_batch

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(text, zone="UTC"):
    t = text.strip()
    mask = re.sub("[A-Za-z]", "A", re.sub("[0-9]", "9", t))
    v = int(parse_batch(pd.Series([t]), pd.Series([zone]), pd.Series([mask]))[0])
    return None if v == np.iinfo(np.int64).min else v


def at(*a):
    return int((datetime(*a, tzinfo=timezone.utc) - EPOCH) / timedelta(microseconds=1))


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("2026-01-02T03:04:05Z", "UTC", at(2026, 1, 2, 3, 4, 5)),
        (" 2026-01-02t03:04:05z\t", "Asia/Kolkata", at(2026, 1, 2, 3, 4, 5)),
        ("2026-01-02T03:04:05.123456789Z", "UTC", at(2026, 1, 2, 3, 4, 5, 123456)),
        ("2026-01-02T03:04:05,5Z", "UTC", at(2026, 1, 2, 3, 4, 5, 500000)),
        ("2026-01-02T03:04:05+0530", "UTC", at(2026, 1, 1, 21, 34, 5)),
        ("2026-01-02T03:04:05.250-08:00[America/Los_Angeles]", "UTC", at(2026, 1, 2, 11, 4, 5, 250000)),
        ("2026-01-02 03:04:05 Europe/Berlin", "UTC", at(2026, 1, 2, 2, 4, 5)),
        ("2026-07-02 03:04 CEST", "UTC", at(2026, 7, 2, 1, 4)),
        ("20260102T030405Z", "UTC", at(2026, 1, 2, 3, 4, 5)),
        ("Fri, 02 Jan 2026 03:04:05 -0500", "UTC", at(2026, 1, 2, 8, 4, 5)),
        ("Jan 2, 2026 12:04 AM EST", "UTC", at(2026, 1, 2, 5, 4)),
        ("1/2/2026 12:04 PM", "UTC", at(2026, 1, 2, 12, 4)),
        ("02.01.2026 03:04", "Australia/Sydney", at(2026, 1, 1, 16, 4)),
        ("2026-01-02", "America/New_York", at(2026, 1, 2, 5)),
        ("1767323045", "UTC", at(2026, 1, 2, 3, 4, 5)),
        ("1767323045.1234567", "UTC", at(2026, 1, 2, 3, 4, 5, 123456)),
        ("1767323045123", "UTC", at(2026, 1, 2, 3, 4, 5, 123000)),
        ("1767323045123456", "UTC", at(2026, 1, 2, 3, 4, 5, 123456)),
        ("2026-10-25 02:30:00", "Europe/Berlin", at(2026, 10, 25, 0, 30)),  # twice: the earlier
        ("2026-03-29 02:30:00", "Europe/Berlin", at(2026, 3, 29, 1, 30)),  # never: moved on by the gap
        ("2026-01-02 03:04:05", "Nowhere/Atall", at(2026, 1, 2, 3, 4, 5)),  # a row's unknown zone is UTC
        ("2026-01-02 03:04:05 Nowhere/Atall", "UTC", None),
        ("2026-02-30T10:00:00Z", "UTC", None),
        ("0000-00-00 00:00:00", "UTC", None),
        ("25:61", "UTC", None),
        ("2026-05-", "UTC", None),
        ("yesterday", "UTC", None),
        ("13/40/2026 1:00 AM", "UTC", None),
        ("1/2/2026 13:00 PM", "UTC", None),
        ("2026-01-02X03:04:05Z", "UTC", None),
        ("x" * 5000, "UTC", None),
    ],
)
def test_forms(text, zone, want):
    assert micros(text, zone) == want


def test_zone_tables_agree_with_the_database():
    rng = random.Random(5)
    for name in ("Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"):
        zone = ZoneInfo(name)
        local = np.array([rng.randrange(0, 4000000000) for _ in range(3000)])
        got = local_to_utc(local, name)
        for x, g in zip(local.tolist(), got.tolist()):
            naive = datetime(1970, 1, 1) + timedelta(seconds=x)
            want = int((naive.replace(tzinfo=zone, fold=0) - EPOCH).total_seconds())
            assert g == want, (name, naive)


def test_frame_keeps_other_columns_and_handles_empty(spark):
    rows = [(1, "2026-01-02", None, "a"), (1, "2026-01-02", " ", "a"), (2, None, "UTC", "b"), (3, "", "UTC", "c")]
    df = spark.createDataFrame(rows, "id int, ts string, zone string, mask string")
    got = normalise(df, "ts", "zone").orderBy("id").collect()
    assert [r.utc_micros for r in got] == [at(2026, 1, 2), at(2026, 1, 2), None, None]
    assert got[0]["mask"] == "a"
    assert normalise(df.filter(F.lit(False)), "ts").count() == 0


def test_texts_of_any_length(spark):
    rows = [("2026-01-02T03:04:05." + "1" * 200 + "Z",), ("x" * 100_000,), ("2026-01-02" + " " * 300,)]
    got = [r.utc_micros for r in normalise(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got == [at(2026, 1, 2, 3, 4, 5, 111111), None, at(2026, 1, 2)]
