"""Bounds of dates written in words, with their precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def schedule_bounds(text: Column) -> Column:
    """struct(due_start, due_end, precision) of a date text: day, month, year, fiscal_year (April to March) or unknown.

    Wide digits count as digits.  A text that speaks of a fiscal year is one if it names its year, else unknown, whatever else it
    says.  Otherwise the first month counts, with its day if one follows; without year, or where it is no real date, it is unknown.
    Only a text without month can be a year, unless it names a season or a third of a month.  Unknown has null bounds; so has null.
    """
    t = F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９", "0123456789")
    month_p = r"(?:(\d{4})年)?(\d{1,2})月(?:(\d{1,2})日)?"
    year, month, day = (F.nullif(F.regexp_extract(t, month_p, i), F.lit("")) for i in (1, 2, 3))
    fiscal, alone = (F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"(\d{4})年度", r"(\d{4})年"))

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    none = F.lit(None).cast("date")

    def bounds(start: Column, end: Column, precision: Column) -> Column:
        good = start.isNotNull() & end.isNotNull()
        return F.struct(F.when(good, start).alias("due_start"), F.when(good, end).alias("due_end"), F.when(good, precision).otherwise(F.lit("unknown")).alias("precision"))

    unknown = bounds(none, none, F.lit("unknown"))
    start = F.when(year.isNotNull(), date(year, month, F.coalesce(day, F.lit("1"))))
    april, january = date(fiscal, F.lit("4"), F.lit("1")), date(alone, F.lit("1"), F.lit("1"))
    return (
        F.when(F.contains(t, F.lit("年度")), F.when(fiscal.isNotNull(), bounds(april, F.date_sub(F.add_months(april, 12), 1), F.lit("fiscal_year"))).otherwise(unknown))
        .when(month.isNotNull(), F.when(start.isNotNull(), bounds(start, F.when(day.isNotNull(), start).otherwise(F.last_day(start)), F.when(day.isNotNull(), F.lit("day")).otherwise(F.lit("month")))).otherwise(unknown))
        .when(alone.isNotNull() & ~t.rlike("春|夏|秋|冬|上旬|中旬|下旬"), bounds(january, F.date_sub(F.add_months(january, 12), 1), F.lit("year")))
        .otherwise(unknown)
    )
