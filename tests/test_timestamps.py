from datetime import datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.operators.timestamps import days_from_civil, instant, month_days, with_instant


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


NOON = us(2026, 3, 5, 12, 4, 5)


@pytest.mark.parametrize(
    "text",
    [
        "2026-03-05T12:04:05Z", "2026-03-05t12:04:05z", "20260305T120405Z", "20260305120405+0000", "2026-03-05T21:04:05+09:00[Asia/Tokyo]",
        "Thu, 05 Mar 2026 12:04:05 GMT", "Thursday, 05-Mar-26 12:04:05 GMT", "Thu, 5 Mar 2026 07:04:05 EST", "Mar 5, 2026 13:04:05 +01:00",
        "Thu Mar 5 12:04:05 UTC 2026", "2026年3月5日 21:04:05 JST", "2026年3月5日(木) 午後9時4分5秒 JST", "令和8年3月5日 21:04:05 +0900", "２０２６-03-05T12:04:05Z",
        str(NOON // 1_000_000), str(NOON // 1_000), str(NOON), str(NOON * 1_000),
    ],
)
def test_ways_of_writing(text):
    assert instant(text) == NOON


@pytest.mark.parametrize(
    "text",
    [None, "", "N/A", "2026", "2026-03", "2026年3月", "2026-03-05", "18:55", "2026-02-30T10:00:00Z", "2026-13-01T10:00:00Z", "2026-03-05T25:00:00Z", "2026-03-05T10:60:00Z", "2026-03-05T10:00:00+19:00", "12345", "1234567890", "2026-03-05T10:00:00 XYZ", "午後13時"],
)
def test_no_instant(text):
    assert instant(text, "Asia/Tokyo", "ymd") is None


def test_wall_clock():
    assert instant("2026-03-05 21:04:05", "Asia/Tokyo", "ymd") == NOON
    assert instant("2026-03-05 21:04:05") is None
    assert instant("2026-03-05 21:04:05", "No/Such", "ymd") is None
    assert instant("2026-03-08 02:30", "America/New_York", "mdy") is None  # skipped
    assert instant("2026-11-01 01:30", "America/New_York", "mdy") is None  # shown twice
    assert instant("2026-11-01 01:30 EDT", "America/New_York", "mdy") == us(2026, 11, 1, 5, 30)


def test_date_order():
    assert instant("03/05/2026 12:00 PM", "UTC", "mdy") == us(2026, 3, 5, 12)
    assert instant("03/05/2026 12:00 AM", "UTC", "dmy") == us(2026, 5, 3)
    assert instant("03/05/2026 12:00", "UTC", None) is None
    assert instant("2026/05/03 00:00", "UTC", "dmy") == us(2026, 5, 3)


def test_fractions():
    assert instant("2026-03-05T12:04:05.123456Z") == NOON + 123456
    assert instant("2026-03-05T12:04:05.5Z") == NOON + 500000


@given(st.dates())
def test_day_arithmetic(day):
    assert days_from_civil(day.year, day.month, day.day) == day.toordinal() - 719163
    assert 28 <= month_days(day.year, day.month) <= 31


def test_operator(spark):
    feeds = spark.createDataFrame([("a", "Asia/Tokyo", "ymd"), ("a", "Asia/Tokyo", "ymd"), (None, "UTC", "ymd")], "feed_name string, tz_name string, date_order string")
    rows = spark.createDataFrame([(1, "2026-03-05 21:04:05", "a"), (2, "2026-03-05 21:04:05", None), (3, None, "a"), (4, "x" * 100_000, "a"), (5, "2026-03-05 21:04:05", "b")], "id int, published string, feed_name string")
    found = {r["id"]: r["utc_us"] for r in with_instant(rows, "published", rows["feed_name"], feeds).collect()}
    assert found == {1: NOON, 2: None, 3: None, 4: None, 5: None}
    assert with_instant(rows.limit(0), "published", rows["feed_name"], feeds).count() == 0
