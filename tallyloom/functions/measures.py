"""Named aggregates and rates.  Numerator and denominator of a rate share one filter set."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.functions.filters import has_text


def n_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def rate(numerator: Column, denominator: Column) -> Column:
    """Null where there is nothing to measure; a null numerator is 0."""
    return F.try_divide(F.coalesce(numerator, F.lit(0)).cast("double"), denominator.cast("double"))


def negative(severity: str | None = None) -> Column:
    is_negative = F.col("sentiment") == "negative"
    return is_negative if severity is None else is_negative & (F.col("severity") == severity)


def positive() -> Column:
    return F.col("sentiment") == "positive"


def negative_with_text(severity: str) -> Column:
    return negative(severity) & has_text()


def half_even(value: Column, digits: int) -> Column:
    """Rounding of reports: halves go to the even digit."""
    return F.bround(value, digits)


def display(column: Column, labels: dict[str, str]) -> Column:
    """A key's label, or the key."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, column), column)


def percent_label(count: Column, total: Column, digits: int = 1) -> Column:
    """``12.4% (298/2,401)``; a dash where there is no denominator."""
    share = F.format_number(F.try_divide(count.cast("double") * 100, total.cast("double")), digits)
    text = F.concat(share, F.lit("% ("), F.format_number(count, 0), F.lit("/"), F.format_number(total, 0), F.lit(")"))
    return F.coalesce(text, F.lit("—"))


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "high", 1).when(F.col(column) == "medium", 2).otherwise(3)


def ranked(items: Column, k: int) -> Column:
    """First ``k`` of an array of structs in their natural order."""
    return F.slice(F.array_sort(items), 1, k)


def delta_cell(current: Column, reference: Column, digits: int = 0) -> Column:
    """A compared value as text: the reference and the signed difference, as a difference says nothing alone."""
    d = current - reference
    number = lambda x: F.format_number(x.cast("double"), digits)
    said = F.when(F.abs(d) < 10**-digits / 2, "–").when(d > 0, F.concat(F.lit("+"), number(d))).otherwise(number(d))
    return F.when(reference.isNull(), "—").otherwise(F.concat(number(reference), F.lit(" ("), said, F.lit(")")))
