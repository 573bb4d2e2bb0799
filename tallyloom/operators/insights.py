"""Zone, category and place insights."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import dates, domain, filters as f, measures as m
from tallyloom.tables import Tables

# Place types by category and by words of the name, in order.
TYPE_OF_CATEGORY = {
    "คาเฟ่": "คาเฟ่",
    "ร้านกาแฟ": "คาเฟ่",
    "coffee shop": "คาเฟ่",
    "cafe": "คาเฟ่",
    "ร้านขนม": "คาเฟ่",
    "bakery": "คาเฟ่",
    "เบเกอรี่": "คาเฟ่",
    "ร้านเบเกอรี่": "คาเฟ่",
    "ร้านอาหาร": "ร้านอาหาร",
    "restaurant": "ร้านอาหาร",
    "ร้านอาหารไทย": "ร้านอาหาร",
    "thai restaurant": "ร้านอาหาร",
    "ร้านก๋วยเตี๋ยว": "ร้านอาหาร",
    "noodle shop": "ร้านอาหาร",
    "ร้านอาหารตามสั่ง": "ร้านอาหาร",
    "buffet restaurant": "ร้านอาหาร",
    "วัด": "สถานที่ท่องเที่ยว",
    "buddhist temple": "สถานที่ท่องเที่ยว",
    "temple": "สถานที่ท่องเที่ยว",
    "สถานที่ท่องเที่ยว": "สถานที่ท่องเที่ยว",
    "tourist attraction": "สถานที่ท่องเที่ยว",
    "พิพิธภัณฑ์": "สถานที่ท่องเที่ยว",
    "museum": "สถานที่ท่องเที่ยว",
    "อุทยานแห่งชาติ": "สถานที่ท่องเที่ยว",
    "national park": "สถานที่ท่องเที่ยว",
    "สวนสาธารณะ": "สถานที่ท่องเที่ยว",
    "park": "สถานที่ท่องเที่ยว",
    "น้ำตก": "สถานที่ท่องเที่ยว",
    "waterfall": "สถานที่ท่องเที่ยว",
    "ตลาด": "สถานที่ท่องเที่ยว",
    "market": "สถานที่ท่องเที่ยว",
}
TYPE_OF_NAME = (
    ("คาเฟ่", ("cafe", "coffee", "คาเฟ่", "คาเฟ", "กาแฟ", "ชา", "bakery", "บาเกอรี")),
    ("ร้านอาหาร", ("ร้านอาหาร", "อาหาร", "restaurant", "ข้าว", "ก๋วยเตี๋ยว", "บุฟเฟ่", "ชาบู", "แกง")),
    ("สถานที่ท่องเที่ยว", ("วัด", "อุทยาน", "พิพิธภัณฑ์", "น้ำตก", "เขื่อน", "สวน", "ถนนคนเดิน", "ตลาด", "บึง", "หาด", "พระราชวัง", "museum", "park", "street art")),
)
# End of fixed values.


def place_type(name: Column, category: Column) -> Column:
    """By the whole category, else by a part of it, else by words of the name."""
    c = F.nullif(F.lower(F.trim(category)), F.lit(""))
    table = F.create_map(*(F.lit(x) for pair in TYPE_OF_CATEGORY.items() for x in pair))
    parts = F.coalesce(*(F.when(c.contains(k), v) for k, v in TYPE_OF_CATEGORY.items()))
    names = F.coalesce(*(F.when(f.matches_any(F.lower(name), words), t) for t, words in TYPE_OF_NAME))
    return F.coalesce(F.try_element_at(table, c), parts, names, F.lit("ทั่วไป"))


def places_with_reviews(t: Tables, status: str, date_from: str | None, date_to: str | None) -> DataFrame:
    """Places of a status with their labelled reviews.  Without dates places without reviews stay; with dates they go."""
    period = f.in_period(date_from, date_to)
    labelled = t.labelled("left").withColumnRenamed("id", "review_id")
    labelled = labelled.select("review_id", "place_id", "text_clean", "analysis_id", "sentiment", "pain_point_category", "severity", "review_date_approx").where(f.all_of(period))
    return t.places.where(f.all_of(f.status_is(status))).join(labelled, t.places["id"] == labelled["place_id"], "left" if period is None else "inner")


def base_counts(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Denominators of labelled reviews that have text."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_with_text"),
        m.n_if(m.negative()).alias("negative"),
        m.n_if(m.positive()).alias("positive"),
        m.n_if(F.col("sentiment") == "neutral").alias("neutral"),
        *(m.n_if(m.negative(s)).alias(f"negative_{s}") for s in domain.SEVERITIES),
    )


def selected(t: Tables, view: str = "all", status: str = "all", date_from=None, date_to=None, zone: str | None = None, more: Column | None = None) -> DataFrame:
    """Labelled reviews with text that pass one filter set."""
    return t.star().where(f.all_of(f.has_text(), f.view_is(view), f.status_is(status), f.in_period(date_from, date_to), None if zone is None else f.zone_of() == zone, more))


def zone_summary(t: Tables, date_from=None, date_to=None, status: str = "operational") -> DataFrame:
    problem = m.negative() & f.has_text() & f.is_problem()
    zones = (
        places_with_reviews(t, status, date_from, date_to)
        .groupBy(f.zone_of().alias("zone"))
        .agg(
            F.countDistinct("id").alias("place_count"),
            F.count("review_id").alias("review_count"),
            F.count("analysis_id").alias("analyzed_count"),
            *(m.n_if(m.negative_with_text(s)).alias(f"{s}_count") for s in domain.SEVERITIES),
            F.mode(F.when(problem, F.col("pain_point_category")), True).alias("top_category"),
            m.n_if(F.col("analysis_id").isNotNull() & f.has_text()).alias("total_with_text"),
            m.n_if(m.negative() & f.has_text()).alias("negative_count"),
        )
    )
    label = m.display(F.col("zone"), domain.ZONE_LABELS)
    return zones.withColumns({"label": label, "complaint_rate": m.rate(F.col("negative_count"), F.col("total_with_text"))}).orderBy(F.desc("analyzed_count"), "zone")


def top_categories(rows: DataFrame, k: int | None = 10) -> DataFrame:
    """Categories by number of reviews; ties by name."""
    counted = rows.where("pain_point_category IS NOT NULL").groupBy(F.col("pain_point_category").alias("category")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category")
    return counted if k is None else counted.limit(k)


def category_shares(t: Tables, view="complaints", status="operational", date_from=None, date_to=None, zone=None, k=10) -> DataFrame:
    """Top categories with their share of negative reviews (complaints only) and of all, and the denominators."""
    base = base_counts(selected(t, "all", status, date_from, date_to, zone))
    top = top_categories(selected(t, view, status, date_from, date_to, zone), k)
    share = m.rate(F.col("count"), F.col("negative")) if view == "complaints" else F.lit(None).cast("double")
    rows = top.crossJoin(base).withColumns({"share_of_negative": share, "rate_of_all": m.rate(F.col("count"), F.col("total_with_text")), "complaint_rate": m.rate(F.col("negative"), F.col("total_with_text"))})
    return rows.withColumns({f"share_{s}": m.rate(F.col(f"negative_{s}"), F.col("negative")) for s in domain.SEVERITIES})


def zone_breakdown(t: Tables, zone: str, view="complaints", status="operational", date_from=None, date_to=None) -> DataFrame:
    """Each place type of a zone with its five worst places and five top categories."""
    in_zone = f.zone_of() == zone
    per_place = (
        places_with_reviews(t, status, date_from, date_to)
        .where(in_zone)
        .groupBy("id", "name", "google_category")
        .agg(*(m.n_if(m.negative(s)).alias(s) for s in domain.SEVERITIES))
        .withColumn("type", place_type(F.col("name"), F.col("google_category")))
    )
    types = per_place.groupBy("type").agg(
        F.count(F.lit(1)).alias("place_count"),
        *(F.sum(s).alias(f"{s}_total") for s in domain.SEVERITIES),
    )
    worst = per_place.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("high"), "name"))).where("rank <= 5")
    worst = worst.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "high"))), lambda x: F.struct(x["name"].alias("name"), x["high"].alias("high_count"))).alias("top_places"))
    pains = selected(t, view, status, date_from, date_to, zone).where("pain_point_category IS NOT NULL")
    pains = pains.withColumn("type", place_type(F.col("place_name"), F.col("google_category"))).groupBy("type", F.col("pain_point_category").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    pains = pains.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("count"), "category"))).where("rank <= 5")
    pains = pains.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category", "count"))), lambda x: F.struct(x["category"].alias("category"), x["count"].alias("count"))).alias("top_pain_points"))
    order = F.array_position(F.array(*(F.lit(x) for x in domain.PLACE_TYPES)), F.col("type"))
    return types.join(worst, "type", "left").join(pains, "type", "left").withColumn("type_order", order).orderBy("type_order")


def _category_filter(category: str | None, view: str) -> Column | None:
    if category:
        return F.col("pain_point_category") == category
    return f.is_problem() if view in ("complaints", "praise") else None


def _feeling(view: str) -> Column | None:
    return {"complaints": m.negative(), "praise": m.positive()}.get(view)


def category_places(t: Tables, category=None, zone=None, status="operational", view="complaints", date_from=None, date_to=None, k=50) -> DataFrame:
    rows = selected(t, "all", status, date_from, date_to, zone, f.all_of(_category_filter(category, view), _feeling(view)))
    counted = rows.groupBy("place_id", "place_name", f.zone_of().alias("zone"), F.coalesce("business_status", F.lit("operational")).alias("business_status")).agg(
        F.count(F.lit(1)).alias("total"),
        *(m.n_if(F.col("severity") == s).alias(s) for s in domain.SEVERITIES),
        m.n_if(m.negative()).alias("neg"),
        m.n_if(m.positive()).alias("pos"),
        m.n_if(f.is_neutral()).alias("neu"),
    )
    return counted.orderBy(F.desc("total"), "place_id").limit(k)


def category_reviews(t: Tables, place_id: int, category=None, severity=None, sentiment=None, view="complaints", date_from=None, date_to=None, k=30) -> DataFrame:
    """Reviews of one place; by design without a status filter."""
    feeling = {"neutral": f.is_neutral(), "negative": m.negative(), "positive": m.positive()}.get(sentiment)
    wanted = f.all_of(F.col("place_id") == place_id, f.has_text(), _category_filter(category, view), _feeling(view), None if severity is None else F.col("severity") == severity, feeling, f.in_period(date_from, date_to))
    rows = t.labelled().where(wanted).orderBy(m.severity_rank(), F.desc_nulls_last("review_date_approx"), F.desc("id")).limit(k)
    return rows.select("id", F.col("text_clean").alias("text"), "rating", "severity", "sentiment", F.col("review_date_approx").alias("date"))


def totals(t: Tables, status="operational", date_from=None, date_to=None) -> DataFrame:
    """One row: places, reviews and labelled reviews, and the has-text base."""
    period = f.in_period(date_from, date_to)
    n_places = t.places.where(f.all_of(f.status_is(status))).agg(F.count(F.lit(1)).alias("total_places"))
    reviews = t.star("left").where(f.all_of(period, f.status_is(status)))
    counted = reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count("analysis_id").alias("total_analyzed"),
        m.n_if(F.col("analysis_id").isNotNull() & f.has_text()).alias("total_with_text"),
        m.n_if(m.negative() & f.has_text()).alias("negative"),
        m.n_if(m.positive() & f.has_text()).alias("positive"),
        m.n_if((F.col("sentiment") == "neutral") & f.has_text()).alias("neutral"),
        *(m.n_if(m.negative_with_text(s)).alias(f"negative_{s}") for s in domain.SEVERITIES),
    )
    return n_places.crossJoin(counted).withColumn("complaint_rate", m.rate(F.col("negative"), F.col("total_with_text")))


def severity_distribution(t: Tables, date_from=None, date_to=None) -> DataFrame:
    """Negative reviews by severity; by design neither status nor text counts."""
    return t.labelled().where(f.all_of(m.negative(), F.col("severity").isNotNull(), f.in_period(date_from, date_to))).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def worst_places(t: Tables, date_from=None, date_to=None, k=10) -> DataFrame:
    rows = t.star().where(f.all_of(f.in_period(date_from, date_to))).groupBy("place_id", "place_name").agg(m.n_if(m.negative("high")).alias("high_count"))
    return rows.orderBy(F.desc("high_count"), "place_id").limit(k)


def top_places(t: Tables, limit=10, status="operational", date_from=None, date_to=None, sort="count", min_reviews=30) -> DataFrame:
    rows = t.star().where(f.all_of(f.status_is(status), f.in_period(date_from, date_to)))
    counted = rows.groupBy(F.col("place_id").alias("id"), F.col("place_name").alias("name"), "overall_rating", F.coalesce("business_status", F.lit("operational")).alias("business_status")).agg(
        m.n_if(f.has_text()).alias("review_count"), m.n_if(m.negative_with_text("high")).alias("high_count"), m.n_if(m.negative_with_text("medium")).alias("medium_count")
    )
    counted = counted.withColumn("high_rate", m.rate(F.col("high_count"), F.col("review_count")))
    if sort == "rate":
        return counted.where(F.col("review_count") >= min_reviews).orderBy(F.desc_nulls_last("high_rate"), F.desc("high_count"), "id").limit(limit)
    return counted.orderBy(F.desc("high_count"), F.desc("medium_count"), "id").limit(limit)


def positive_highlights(t: Tables, zone=None, limit=5, status="operational", date_from=None, date_to=None) -> DataFrame:
    """Most praised categories; the share's denominator is all praise, not only what is listed."""
    counted = top_categories(selected(t, "praise", status, date_from, date_to, zone), None)
    whole = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_praise"))
    return counted.limit(limit).crossJoin(whole).withColumn("share_of_praise", m.rate(F.col("count"), F.col("total_praise")))


def category_counts(t: Tables, status="all", date_from=None, date_to=None) -> DataFrame:
    """All categories, the non-problem ones too."""
    return top_categories(selected(t, "all", status, date_from, date_to), None)


def trending(t: Tables, as_of: date, period="month", buckets=6, top=5, zone=None, date_from=None, date_to=None, status="all") -> DataFrame:
    """Counts, rates and shares of the top problems by week or month of the review.

    Without dates: the last ``buckets`` before the current one, which is left out.  A row
    for each bucket with a complaint about a top problem, and each top problem (0 if none).
    """
    unit = "week" if period == "week" else "month"
    window = f.in_period(date_from, date_to)
    if window is None:
        now = dates.trunc(as_of, unit)
        window = (F.col("review_date_approx") < F.lit(now)) & (F.col("review_date_approx") >= F.lit(dates.back(now, unit, buckets)))
    rows = selected(t, "all", status, zone=zone, more=F.col("review_date_approx").isNotNull() & window).withColumn("bucket", dates.bucket(F.col("review_date_approx"), unit))
    problems = rows.where(m.negative() & f.is_problem())
    leading = top_categories(problems, top).select("category")
    cells = problems.withColumnRenamed("pain_point_category", "category").join(leading, "category", "left_semi").groupBy("bucket", "category").agg(F.count(F.lit(1)).alias("count"))
    whole = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("bucket_total"), m.n_if(m.negative()).alias("bucket_negative"))
    # At most ``buckets`` (or the days asked for) times ``top`` rows.
    grid = cells.select("bucket").distinct().crossJoin(leading)
    out = grid.join(cells, ["bucket", "category"], "left").fillna(0, ["count"]).join(whole, "bucket", "left").fillna(0, ["bucket_total", "bucket_negative"])
    by_bucket, by_category = Window.partitionBy("bucket"), Window.partitionBy("category").orderBy("bucket")
    return out.withColumns(
        {
            "total": F.sum("count").over(by_bucket),
            "rate": m.rate(F.col("count"), F.col("bucket_total")),
            "share": m.rate(F.col("count"), F.col("bucket_negative")),
            "complaint_rate": m.rate(F.col("bucket_negative"), F.col("bucket_total")),
            "low_confidence": F.col("bucket_total") < domain.LOW_CONFIDENCE_MIN,
            "delta": F.col("count") - F.lag("count").over(by_category),
        }
    )


def place_map(t: Tables, status="all", date_from=None, date_to=None) -> DataFrame:
    """Each place with coordinates: dominant severity, categories, high severity (any feeling, any text)."""
    rows = places_with_reviews(t, status, date_from, date_to).where("lat IS NOT NULL AND lng IS NOT NULL")
    return rows.groupBy("id", "name", F.col("overall_rating").alias("rating"), "lng", "lat").agg(
        F.mode("severity", True).alias("dominant_severity"), F.sort_array(F.collect_set("pain_point_category")).alias("pain_categories"), m.n_if(F.col("severity") == "high").alias("high_count"), F.count("review_id").alias("review_count")
    )
