"""Predicates that every query shares, as Columns."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from tallyloom.functions import domain


def let(value: Column, build) -> Column:
    """``build(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), build), 0)


def parse_iso(text: str | None) -> date | None:
    """A date, or None for anything that isn't one (which then doesn't filter)."""
    try:
        year, month, day = (int(x) for x in text.split("-"))
        return date(year, month, day)
    except (AttributeError, TypeError, ValueError):
        return None


def all_of(*conditions: Column | None) -> Column:
    """Conjunction; None is no condition."""
    return reduce(and_, (c for c in conditions if c is not None), F.lit(True))


def in_period(date_from: str | None = None, date_to: str | None = None, column: str = "review_date_approx") -> Column | None:
    """Closed interval of dates; None if neither end is a date.  Null dates fail it."""
    low, high = parse_iso(date_from), parse_iso(date_to)
    if low is None and high is None:
        return None
    return all_of(None if low is None else F.col(column) >= F.lit(low), None if high is None else F.col(column) <= F.lit(high))


def status_is(status: str = "operational", column: str = "business_status") -> Column | None:
    """closed, all, or (any other word) operational; null counts as operational."""
    if status == "all":
        return None
    known = F.coalesce(F.col(column), F.lit("operational"))
    return known.isin(*domain.CLOSED) if status == "closed" else known == "operational"


def is_problem(column: str = "pain_point_category") -> Column:
    """A category that isn't one of the non-problem ones; null for null."""
    return ~F.col(column).isin(*domain.NON_PROBLEM)


def view_is(view: str = "complaints", sentiment: str = "sentiment", category: str = "pain_point_category") -> Column | None:
    """complaints: negative problems; praise: positive ones; any other word: all."""
    wanted = {"complaints": "negative", "praise": "positive"}.get(view)
    return None if wanted is None else (F.col(sentiment) == wanted) & is_problem(category)


def zone_of(column: str = "zone") -> Column:
    return F.coalesce(F.col(column), F.lit("other"))


def has_text(column: str = "text_clean") -> Column:
    """Two-valued: null is no text."""
    return F.coalesce(F.col(column), F.lit("")) != ""


def is_neutral(column: str = "sentiment") -> Column:
    """Neither negative nor positive, null included."""
    return ~F.col(column).isin("negative", "positive") | F.col(column).isNull()


def matches_any(column: Column, words) -> Column:
    """Whether a text contains one of the words."""
    return reduce(lambda a, b: a | b, (column.contains(w) for w in words), F.lit(False))


def starts_with_any(column: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (column.startswith(w) for w in words), F.lit(False))
