"""Problem 4: one UTC instant for each way of writing a time.

All formats are compiled into one alternation with named groups; a value is matched once, its parts are
checked against the calendar and put together through integer day arithmetic.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Zone abbreviations and their minutes east of UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "CET": 60, "WEST": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# The year before the first of each era.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "R": 2018, "H": 1988, "S": 1925}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? )?"
_MONTH = r"(?P<mon>jan|feb|mar|apr|may|june?|july?|aug|sept?|oct|nov|dec)(?:uary|ruary|ch|il|ust|ember|tember|ober)?\.?"
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,12}))?)?(?: ?(?P<ap>[ap])\.?m\.?)?"
_ZONE = r"(?: ?(?:utc|gmt)?(?P<off>[+-]\d{1,2}(?::?\d{2})?)| ?(?P<abb>[a-z]{1,5}))?(?: ?\((?P<par>[a-z]{3,5})\))?(?: ?\[(?P<zone>[a-z_/+\-0-9]+)\])?"
_KANJI_CLOCK = r"(?P<noon>午前|午後)?(?P<h>\d{1,2})(?:時(?:(?P<mi>\d{1,2})分(?:(?P<s>\d{1,2})秒)?)?|:(?P<mi2>\d{2})(?::(?P<s2>\d{2})(?:[.,](?P<f>\d{1,12}))?)?)"
#: One entry per way of writing, tried in this order on text in compatibility form, without case, with single blanks.
FORMATS = (
    rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?: ?\(.\))?(?:t| t?)(?:{_CLOCK}){_ZONE}",
    rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[t ]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,12}}))?)?{_ZONE}",
    rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[t ]{_CLOCK}{_ZONE}",
    rf"{_DAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH}[ -],? ?(?P<y>\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}",
    rf"{_DAY}{_MONTH} (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}}),?(?: at)? {_CLOCK}{_ZONE}",
    rf"{_DAY}{_MONTH} (?P<d>\d{{1,2}}) {_CLOCK}{_ZONE} (?P<y>\d{{4}})",
    rf"(?:(?P<era>令和|平成|昭和|[rhs])(?P<ey>元|\d{{1,2}})|(?P<y>\d{{4}}))[年./-] ?(?P<m>\d{{1,2}})[月./-] ?(?P<d>\d{{1,2}})日? ?(?:[(][月火水木金土日](?:曜日?)?[)]|[月火水木金土日]曜日?)? ?{_KANJI_CLOCK}{_ZONE}",
    rf"(?P<n1>\d{{1,2}})(?P<sep>[-/.])(?P<n2>\d{{1,2}})(?P=sep)(?P<n3>\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}",
    r"(?P<count>\d{9,19})(?:\.(?P<part>\d{1,9}))?",
)


def compiled(formats: tuple[str, ...] = FORMATS) -> re.Pattern:
    """One alternation; the groups of entry i are named <name>_<i>, the entry itself of_<i>."""
    numbered = (re.sub(r"\(\?P([<=])(\w+)", rf"(?P\g<1>\g<2>_{i}", f) for i, f in enumerate(formats))
    return re.compile("|".join(f"(?P<of_{i}>{f})" for i, f in enumerate(numbered)))


PATTERN = compiled()
_GROUPS = [[(k[: -len(f"_{i}")], k) for k in PATTERN.groupindex if k.endswith(f"_{i}")] for i in range(len(FORMATS))]
DAY_S, UNITS = 86_400, (1_000_000, 1_000, 1)
COUNT_YEARS = (2025, 2026)


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a date of the Gregorian calendar."""
    y -= m <= 2
    era, of_era = divmod(y, 400)
    of_year = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719_468


def month_days(y: int, m: int) -> int:
    return 29 if m == 2 and y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


_COUNT_FROM, _COUNT_TO = (days_from_civil(y, 1, 1) * DAY_S * 1_000_000 for y in (COUNT_YEARS[0], COUNT_YEARS[1] + 1))


def _of_count(digits: str, part: str | None) -> int | None:
    """A mere count, in the one unit of seconds to nanoseconds that leads to the years of all values."""
    whole = int(digits)
    for unit in UNITS:
        if _COUNT_FROM <= whole * unit < _COUNT_TO:
            return whole * unit + (int((part or "").ljust(9, "0")[:9]) * unit // 1_000_000_000 if part else 0)
    return whole // 1_000 if _COUNT_FROM <= whole // 1_000 < _COUNT_TO else None


def _local(seconds: int, zone: str) -> int | None:
    """UTC seconds of wall clock seconds; None if the clock skipped or showed them twice, or the zone is unknown."""
    try:
        wall = (datetime(1970, 1, 1) + timedelta(seconds=seconds)).replace(tzinfo=ZoneInfo(zone))
    except (OSError, ValueError, KeyError, OverflowError):
        return None
    first, second = wall.utcoffset(), wall.replace(fold=1).utcoffset()
    return seconds - int(first.total_seconds()) if first == second else None


def instant(text: str | None, tz_name: str | None = None, date_order: str | None = None) -> int | None:
    """Microseconds since 1970-01-01 UTC that ``text`` names; None if it names no single instant.

    A value without offset or zone is wall clock time in ``tz_name``; without that it is none.
    All-number dates with the year last follow ``date_order`` (mdy or dmy); of an unknown order they are none.
    """
    if not text:
        return None
    found = PATTERN.fullmatch(" ".join(unicodedata.normalize("NFKC", text).lower().split()))
    if not found:
        return None
    g = {name: v for name, k in _GROUPS[int(found.lastgroup[3:])] if (v := found[k]) is not None}
    if "count" in g:
        return _of_count(g["count"], g.get("part"))
    if "n1" in g:
        at = (date_order or "").find
        if date_order not in ("mdy", "dmy", "ymd") or len(g["n3"]) == 4 and date_order == "ymd":
            return None
        parts = (g["n1"], g["n2"], g["n3"])
        y, m, d = (int(parts[at(x)]) for x in "ymd")
        y += 2000 if y < 100 else 0
    else:
        y = ERAS[g["era"].upper()] + (1 if g["ey"] == "元" else int(g["ey"])) if "era" in g else int(g["y"])
        y += 2000 if y < 100 else 0
        m = MONTHS.index(g["mon"][:3]) + 1 if "mon" in g else int(g["m"])
        d = int(g["d"])
    h, mi, s = int(g["h"]), int(g.get("mi") or g.get("mi2") or 0), int(g.get("s") or g.get("s2") or 0)
    if half := g.get("ap") or {"午前": "a", "午後": "p"}.get(g.get("noon", "")):
        if h > 12 or h == 0 and "ap" in g:
            return None
        h = h % 12 + 12 * (half == "p")
    if not (1 <= m <= 12 and y >= 1 and 1 <= d <= month_days(y, m) and h < 24 and mi < 60 and s < 60):
        return None
    seconds = days_from_civil(y, m, d) * DAY_S + h * 3600 + mi * 60 + s
    if "off" in g:
        digits = g["off"][1:].replace(":", "")
        hours, minutes = (int(digits), 0) if len(digits) < 3 else (int(digits[:-2]), int(digits[-2:]))
        if hours > 14 or minutes > 59:
            return None
        utc = seconds - (-1 if g["off"][0] == "-" else 1) * (hours * 3600 + minutes * 60)
    elif "abb" in g:
        if g["abb"].upper() not in ZONES:
            return None
        utc = seconds - ZONES[g["abb"].upper()] * 60
    else:
        zone = "/".join("_".join(w.capitalize() for w in p.split("_")) for p in g["zone"].split("/")) if "zone" in g else tz_name
        utc = _local(seconds, zone.upper() if zone in ("Utc", "Gmt") else zone) if zone else None
    return None if utc is None else utc * 1_000_000 + int((g.get("f") or "0").ljust(6, "0")[:6])


@arrow_udf(T.LongType())
def utc_micros(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``instant`` of (text, tz_name, date_order), once for each distinct triple of a batch."""
    for columns in batches:
        known: dict[tuple, int | None] = {}
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        yield pa.array([known[r] if r in known else known.setdefault(r, instant(*r)) for r in rows], pa.int64())


def with_instant(df: DataFrame, text: str, feed: Column, feeds: DataFrame, into: str = "utc_us") -> DataFrame:
    """Add ``into``, the UTC instant of ``text`` in microseconds, null where it names none.

    ``feeds`` (feed_name, tz_name, date_order) gives the clock and the date order of each feed; of a name
    listed twice the first row in order of zone and date order counts.  Null feeds match none.
    """
    clocks = feeds.where("feed_name is not null").groupBy("feed_name").agg(F.min(F.struct("tz_name", "date_order")).alias("_clock"))
    matched = df.withColumn("_feed", feed).join(clocks.withColumnRenamed("feed_name", "_feed"), "_feed", "left")
    return matched.withColumn(into, utc_micros(F.col(text), F.col("_clock.tz_name"), F.col("_clock.date_order"))).drop("_feed", "_clock")
