"""Monthly report: one month against the month before, the same month a year before and the mean."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions import dates, domain, filters as f, measures as m
from tallyloom.tables import Tables


def months_with_data(t: Tables, as_of: date, least=10, most=24) -> DataFrame:
    """Months before the current one with enough reviews that have text, latest first."""
    now = dates.trunc(as_of, "month")
    rows = t.reviews.where(f.has_text() & (F.col("review_date_approx") < F.lit(now)))
    counted = rows.groupBy(F.year("review_date_approx").alias("year"), F.month("review_date_approx").alias("month")).agg(F.count(F.lit(1)).alias("reviews")).where(F.col("reviews") >= least)
    return counted.withColumn("label", dates.buddhist_month(F.col("year"), F.col("month"))).orderBy(F.desc("year"), F.desc("month")).limit(most)


MEASURES = ("reviews", "complaints", "praise", "high", "medium", "low", "places")


def _within(start: date, end: date):
    return (F.col("review_date_approx") >= F.lit(start)) & (F.col("review_date_approx") < F.lit(end))


def by_month(t: Tables, start: date, end: date, status="operational") -> DataFrame:
    rows = t.star("left").where(f.all_of(_within(start, end), f.status_is(status)))
    text = f.has_text()
    return rows.groupBy(dates.bucket(F.col("review_date_approx"), "month").alias("bucket")).agg(
        m.n_if(text).alias("reviews"),
        m.n_if(m.negative() & text).alias("complaints"),
        m.n_if(m.positive() & text).alias("praise"),
        *(m.n_if(m.negative_with_text(s)).alias(s) for s in domain.SEVERITIES),
        F.countDistinct(F.when(text, F.col("place_id"))).alias("places"),
        m.n_if(~text).alias("excluded_no_text"),
    )


def summary(t: Tables, year: int, month: int, status="operational") -> DataFrame:
    """One row: each measure now (cur_), the month before (prev_), a year before (ly_) and its mean (avg_)."""
    start, end = dates.month_range(year, month)
    before, year_before = dates.back(start, "month", 1), dates.back(start, "month", 12)
    months = by_month(t, year_before, end, status)
    at = lambda day, name: F.coalesce(F.sum(F.when(F.col("bucket") == F.lit(day), F.col(name))), F.lit(0))
    later = F.col("bucket") != F.lit(year_before)
    columns = [at(d, n).alias(f"{p}_{n}") for p, d in (("cur", start), ("prev", before), ("ly", year_before)) for n in MEASURES]
    # The mean is over months with data, without the one a year before.
    columns += [F.coalesce(F.bround(F.avg(F.when(later, F.col(n))), 1), F.lit(0.0)).alias(f"avg_{n}") for n in MEASURES]
    one = months.agg(*columns, at(start, "excluded_no_text").alias("excluded_no_text"), m.n_if(later).alias("avg_months"), (m.n_if(F.col("bucket") == F.lit(year_before)) > 0).alias("ly_available"))
    total = t.places.where(f.all_of(f.status_is(status))).agg(F.count(F.lit(1)).alias("total_places"))
    return one.crossJoin(total).withColumns({"complaint_delta": F.col("cur_complaints") - F.col("prev_complaints"), "places_delta": F.col("cur_places") - F.col("prev_places")})


def top_problems(t: Tables, year: int, month: int, status="operational", k=8) -> DataFrame:
    """Categories of the month with their counts in the month before; pct is of all complaints."""
    start, end = dates.month_range(year, month)
    before = dates.back(start, "month", 1)
    rows = t.star().where(f.all_of(_within(before, end), f.has_text(), f.status_is(status), m.negative()))
    now = F.col("review_date_approx") >= F.lit(start)
    whole = rows.agg(m.n_if(now).alias("all_complaints"))
    counted = rows.where(f.is_problem()).groupBy(F.col("pain_point_category").alias("category")).agg(m.n_if(now).alias("count"), m.n_if(now & (F.col("severity") == "high")).alias("high"), m.n_if(~now).alias("prev"))
    top = counted.where("count > 0").orderBy(F.desc("count"), "category").limit(k).crossJoin(whole)
    return top.withColumns({"pct": F.bround(F.col("count") / F.col("all_complaints") * 100, 1), "delta": F.col("count") - F.col("prev")}).drop("all_complaints")


def _month(t: Tables, year: int, month: int, status: str, how="inner") -> DataFrame:
    return t.star(how).where(f.all_of(_within(*dates.month_range(year, month)), f.has_text(), f.status_is(status)))


def zones(t: Tables, year: int, month: int, status="operational") -> DataFrame:
    rows = _month(t, year, month, status).groupBy(f.zone_of().alias("zone")).agg(
        m.n_if(m.negative()).alias("complaints"), m.n_if(m.positive()).alias("praise"), F.mode(F.when(m.negative() & f.is_problem(), F.col("pain_point_category")), True).alias("top_category")
    )
    return rows.withColumns({"label": m.display(F.col("zone"), domain.ZONE_LABELS), "top_category": F.coalesce("top_category", F.lit("—"))}).orderBy(F.desc("complaints"), "zone")


def worst_places(t: Tables, year: int, month: int, status="operational", k=10) -> DataFrame:
    rows = _month(t, year, month, status).where(m.negative()).groupBy("place_id", F.col("place_name").alias("name"), f.zone_of().alias("zone")).agg(
        F.count(F.lit(1)).alias("complaints"), m.n_if(F.col("severity") == "high").alias("high"), F.mode(F.when(f.is_problem(), F.col("pain_point_category")), True).alias("top_category")
    )
    return rows.withColumn("top_category", F.coalesce("top_category", F.lit("—"))).orderBy(F.desc("complaints"), F.desc("high"), "place_id").limit(k)


def highlights(t: Tables, year: int, month: int, status="operational", k=5) -> DataFrame:
    rows = _month(t, year, month, status).where(m.positive() & f.is_problem()).groupBy(F.col("pain_point_category").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return rows.orderBy(F.desc("count"), "category").limit(k)


def sample_reviews(t: Tables, year: int, month: int, category: str, k=5) -> DataFrame:
    """The worst review of each text of a category (whatever the place's status), five of them."""
    rows = _month(t, year, month, "all").where(m.negative() & (F.col("pain_point_category") == category)).withColumn("sev_rank", m.severity_rank())
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("text_clean").orderBy("sev_rank", "id"))).where("n = 1")
    return first.orderBy("sev_rank", "text_clean").limit(k).select("place_name", "rating", F.substring("text_clean", 1, 220).alias("text"), "sev_rank")
