from datetime import datetime, timezone

import pytest
from brute_time import brute_micros
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlight.operators.timestamps import with_utc_micros
from tarnlight.plans.problems import p5_instants

CASES = [
    ("2024-03-10 02:30:00", "America/New_York", "2024-03-10T07:30:00"),  # skipped: offset from before
    ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00"),  # twice: the first
    ("Mar 10, 2024 2:30 AM ET", "Asia/Tokyo", "2024-03-10T07:30:00"),
    ("2024-02-30 10:00", "UTC", None), ("31.04.2024 10:00", "UTC", None), ("2024-01-01 24:00", "UTC", None), ("13/01/2024 01:00 AM", "UTC", None),
    ("01/02/2024 12:05 AM", "UTC", "2024-01-02T00:05:00"), ("01/02/2024 12:05 PM", "UTC", "2024-01-02T12:05:00"), ("01.02.2024 12:05", "UTC", "2024-02-01T12:05:00"),
    ("2024/01/02 03:04", "Asia/Shanghai", "2024-01-01T19:04:00"), ("2024-05-06", "Europe/London", "2024-05-05T23:00:00"), ("2024年5月6日 07:08", "Asia/Shanghai", "2024-05-05T23:08:00"),
    ("20240506T070809Z", "Asia/Tokyo", "2024-05-06T07:08:09"), ("2024-05-06T07:08:09.1234567Z", None, "2024-05-06T07:08:09.123456"), ("1714979289.5", "x/y", "2024-05-06T07:08:09.500000"),
    ("2024-05-06 07:08 GST", "UTC", "2024-05-06T03:08:00"), ("2024-05-06 07:08 XYZ", "UTC", None), ("T+1", "UTC", None), ("12:30", "UTC", None), ("yesterday", "UTC", None), ("", "UTC", None), (None, "UTC", None),
    ("  2024-05-06T07:08  ", "Not/AZone", "2024-05-06T07:08:00"), ("6 May 2024, 07.08", "UTC", "2024-05-06T07:08:00"), ("Mon, 06 May 2024 07:08:09 -0500", "UTC", "2024-05-06T12:08:09"),
    ("x" * 20000, "UTC", None), ("1714979289123", "UTC", "2024-05-06T07:08:09.123000"),
]


def micros(iso):
    d = datetime.fromisoformat(iso).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return d.days * 86_400_000_000 + d.seconds * 1_000_000 + d.microseconds


def test_cases(spark):
    df = spark.createDataFrame([(i, s, z) for i, (s, z, _) in enumerate(CASES)], "i int, s string, z string")
    got = {r.i: r.u for r in with_utc_micros(df, "s", "z", "u").collect()}
    assert {CASES[i][0]: got[i] for i in got} == {s: (micros(w) if w else None) for s, _, w in CASES}


def test_whole_table_against_plain_parsing(spark, sf):
    rows = p5_instants(spark, sf).collect()
    assert len(rows) > 200 and any(r.utc_us is None for r in rows)
    for r in rows:
        assert r.utc_us == brute_micros(r.written, r.home_zone), r


ZONES = ["America/New_York", "Europe/London", "Asia/Shanghai", "Australia/Sydney", "America/Chicago"]


@given(st.lists(st.tuples(st.datetimes(datetime(2023, 1, 1), datetime(2026, 1, 1)), st.sampled_from(ZONES), st.sampled_from(["%Y-%m-%d %H:%M:%S", "%d.%m.%Y %H:%M", "%m/%d/%Y %I:%M %p", "%d %b %Y, %H.%M"])), min_size=30, max_size=30))
@settings(max_examples=3, deadline=None)
def test_local_times_in_any_zone(spark, rows):
    df = spark.createDataFrame([(d.strftime(f), z) for d, z, f in rows], "s string, z string")
    for r in with_utc_micros(df, "s", "z", "u").collect():
        assert r.u == brute_micros(r.s, r.z), r


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([], "s string, z string, u string")
    assert with_utc_micros(df, "s", "z", "u").count() == 0
    with pytest.raises(Exception):
        with_utc_micros(df, "missing", "z", "u").count()
