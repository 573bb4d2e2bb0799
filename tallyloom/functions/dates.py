"""Relative dates, calendar buckets and ranges."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column, functions as F

from tallyloom.functions import domain
from tallyloom.functions.filters import let, matches_any

# Words of relative dates, in the order they are looked for.
UNITS = (("วัน", 1, 60), ("day", 1, 60), ("สัปดาห์", 7, 8), ("week", 7, 8), ("เดือน", 30, 24), ("month", 30, 24), ("ปี", 365, 20), ("year", 365, 20))
PAST = ("ที่แล้ว", "ที่ผ่านมา", "ago")
TODAY, YESTERDAY = ("วันนี้", "today"), ("เมื่อวาน", "yesterday")
THAI_DIGITS, DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
PHRASE = r"(?iu)(?:(?:แก้ไขเมื่อ|เยี่ยมชมเมื่อ)\s*(?:วันที่)?\s*)?((?:\d+|[๐-๙]+|an?)\s*(?:วัน|สัปดาห์|เดือน|ปี|days?|weeks?|months?|years?)\s*(?:ที่แล้ว|ที่ผ่านมา|ago)|เมื่อวานนี้|เมื่อวาน|วันนี้|yesterday|today)"
# End of fixed values.


def relative_date(text: Column, reference: Column) -> Column:
    """The date that a phrase such as ``3 เดือนที่แล้ว`` or ``a week ago`` names, or null.

    A month is 30 days and a year 365; amounts beyond each unit's cap are no dates.
    """
    cleaned = F.translate(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), THAI_DIGITS, DIGITS)
    reference = reference.cast("date")

    def day(t: Column) -> Column:
        digits = F.regexp_extract(t, r"([0-9]+)", 1)
        amount = F.when(digits == "", 1).otherwise(F.coalesce(digits.try_cast("int"), F.lit(2**31 - 1)))
        unit = F.coalesce(*(F.when(t.contains(word), F.struct(F.lit(days).alias("days"), F.lit(cap).alias("cap"))) for word, days, cap in UNITS))
        ago = let(F.struct(amount.alias("n"), unit.alias("unit")), lambda x: F.when(x["n"] <= x["unit"]["cap"], F.date_sub(reference, x["n"] * x["unit"]["days"])))
        return F.when(t == "", None).when(matches_any(t, TODAY), reference).when(matches_any(t, YESTERDAY), F.date_sub(reference, 1)).when(matches_any(t, PAST), ago)

    return let(cleaned, day)


def relative_phrase(text: Column) -> Column:
    """The first phrase in a text that names a relative date, or null."""
    found = F.regexp_extract(text, PHRASE, 1)
    return F.when(found != "", found)


def bucket(column: Column, unit: str) -> Column:
    """First day of the calendar week (Monday) or month."""
    return F.date_trunc("week" if unit == "week" else "month", column).cast("date")


def trunc(day: date, unit: str) -> date:
    return day - timedelta(days=day.weekday()) if unit == "week" else day.replace(day=1)


def back(day: date, unit: str, n: int) -> date:
    """``n`` weeks or months before a first day."""
    if unit == "week":
        return day - timedelta(weeks=n)
    months = day.year * 12 + day.month - 1 - n
    return date(months // 12, months % 12 + 1, 1)


def month_range(year: int, month: int) -> tuple[date, date]:
    """First day of a month and of the next (its end is exclusive)."""
    start = date(year, month, 1)
    return start, back(start, "month", -1)


def last_days(as_of: date, n: int) -> tuple[str, str]:
    """The n days up to a day, both ends in."""
    return (as_of - timedelta(days=n - 1)).isoformat(), as_of.isoformat()


def last_months(as_of: date, n: int) -> tuple[str, str]:
    """From the same day n months ago (or that month's last) to a day."""
    first = back(as_of.replace(day=1), "month", n)
    return first.replace(day=min(as_of.day, calendar.monthrange(first.year, first.month)[1])).isoformat(), as_of.isoformat()


def whole_month(year: int, month: int) -> tuple[str, str]:
    start, end = month_range(year, month)
    return start.isoformat(), (end - timedelta(days=1)).isoformat()


def whole_year(year: int) -> tuple[str, str]:
    return f"{year:04d}-01-01", f"{year:04d}-12-31"


def buddhist_month(year: Column, month: Column) -> Column:
    """Month name and Buddhist year, for display."""
    names = F.array(*(F.lit(x) for x in domain.THAI_MONTHS))
    return F.concat(F.element_at(names, month.cast("int")), F.lit(" "), (year + domain.BUDDHIST_OFFSET).cast("string"))
