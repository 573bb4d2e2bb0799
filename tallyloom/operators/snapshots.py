"""Snapshots of counts, their comparison and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions import domain, filters as f, measures as m
from tallyloom.tables import Tables


def _until(as_of: date | None):
    """With a day, reviews without date go too."""
    return None if as_of is None else F.col("review_date_approx") <= F.lit(as_of)


def header(t: Tables, snapshot_id: int, label: str | None = None, as_of: date | None = None, note: str | None = None) -> DataFrame:
    reviews = t.labelled("left").where(f.all_of(_until(as_of))).agg(F.count(F.lit(1)).alias("total_reviews"), F.count("analysis_id").alias("total_analyzed"))
    places = t.places.agg(F.count(F.lit(1)).alias("total_places"))
    return places.crossJoin(reviews).select(F.lit(snapshot_id).cast("long").alias("id"), F.lit(label).cast("string").alias("period_label"), "total_places", "total_reviews", "total_analyzed", F.lit(note).cast("string").alias("note"))


def categories(t: Tables, snapshot_id: int, as_of: date | None = None) -> DataFrame:
    """Counts by zone and category, and for the whole province (zone null), in one pass."""
    rows = t.star().where(f.all_of(F.col("pain_point_category").isNotNull(), f.has_text(), _until(as_of)))
    rows = rows.select(f.zone_of().alias("zone"), F.col("pain_point_category").alias("category"), "sentiment", "severity")
    grouped = rows.groupingSets([["category"], ["zone", "category"]], "zone", "category").agg(
        m.n_if(m.negative()).alias("complaint_count"), m.n_if(m.positive()).alias("praise_count"), *(m.n_if(m.negative(s)).alias(f"{s}_count") for s in domain.SEVERITIES)
    )
    return grouped.withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))


def places(t: Tables, snapshot_id: int, as_of: date | None = None) -> DataFrame:
    rows = t.labelled().where(f.all_of(F.col("pain_point_category").isNotNull(), f.has_text(), _until(as_of)))
    grouped = rows.groupBy("place_id", F.col("pain_point_category").alias("category")).agg(m.n_if(m.negative()).alias("complaint_count"), m.n_if(m.positive()).alias("praise_count"), m.n_if(m.negative("high")).alias("high_count"))
    return grouped.withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))


def monthly_categories(t: Tables) -> DataFrame:
    """What :func:`categories` counts as of the last day of every month, from one pass over the reviews.

    Rows are counted by the month they came in; a window then adds the months up over a
    calendar that begins with a group's first month.  The window sees a row for each zone,
    category and month, however many reviews there are.
    """
    rows = t.star().where(f.all_of(F.col("pain_point_category").isNotNull(), f.has_text(), F.col("review_date_approx").isNotNull()))
    rows = rows.select(F.last_day("review_date_approx").alias("as_of"), f.zone_of().alias("zone"), F.col("pain_point_category").alias("category"), "sentiment", "severity")
    counts = {"complaint_count": m.negative(), "praise_count": m.positive(), **{f"{s}_count": m.negative(s) for s in domain.SEVERITIES}}
    came = rows.groupingSets([["as_of", "category"], ["as_of", "zone", "category"]], "as_of", "zone", "category").agg(*(m.n_if(c).alias(n) for n, c in counts.items()))
    # One row: the last month that any review came in.
    last = came.agg(F.max("as_of").alias("last"))
    span = came.groupBy("zone", "category").agg(F.min("as_of").alias("first")).crossJoin(last)
    calendar = span.select(F.col("zone").alias("_z"), F.col("category").alias("_c"), F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("INTERVAL 1 MONTH"))).alias("_m")).withColumn("_m", F.last_day("_m"))
    both = calendar.join(came, F.col("_z").eqNullSafe(F.col("zone")) & (F.col("_c") == F.col("category")) & (F.col("_m") == F.col("as_of")), "left")
    upto = Window.partitionBy("_z", "_c").orderBy("_m")
    return both.select(F.col("_m").alias("as_of"), F.col("_z").alias("zone"), F.col("_c").alias("category"), *(F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in counts))


def daily_sketches(rows: DataFrame, day: str, by: list[str], value: str, lg_k: int = 12) -> DataFrame:
    """HyperLogLog sketches of a column's distinct values by day and keys, to be kept and united for any range.

    A sketch has at most 2**lg_k registers; the standard error of its estimate is about
    1.04 / sqrt(2**lg_k): 1.6 % at 12.
    """
    return rows.groupBy(F.col(day).alias("day"), *by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def distinct_in(sketches: DataFrame, by: list[str], date_from=None, date_to=None) -> DataFrame:
    """Estimated distinct values of each key within a range of days, from stored sketches alone."""
    rows = sketches.where(f.all_of(None if date_from is None else F.col("day") >= F.lit(date_from), None if date_to is None else F.col("day") <= F.lit(date_to)))
    return rows.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def latest(snapshots: DataFrame, limit=20) -> DataFrame:
    return snapshots.orderBy(F.desc("taken_at"), F.desc("id")).limit(limit)


def with_sizes(snapshots: DataFrame, snapshot_categories: DataFrame) -> DataFrame:
    """Snapshots with their numbers of category rows."""
    sizes = snapshot_categories.groupBy(F.col("snapshot_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return snapshots.join(sizes, "id", "left").fillna(0, ["n_rows"])


def compare(t: Tables, snapshot_categories: DataFrame, snapshot_places: DataFrame, from_id: int, to_id: int, zone: str | None = None, min_delta: int = 1) -> DataFrame:
    """Categories whose complaints grew, with where: in one place (concentrated) or in many.

    Place deltas cover the whole province even if ``zone`` picks the categories.
    """
    wanted = F.col("zone").isNull() if zone is None else F.col("zone") == zone
    own = snapshot_categories.where(wanted)
    after = own.where(F.col("snapshot_id") == to_id).select("category", F.col("complaint_count").alias("after"), F.col("high_count"))
    before = own.where(F.col("snapshot_id") == from_id).select("category", F.col("complaint_count").alias("before"))
    both = after.join(before, "category", "full").fillna(0, ["after", "before", "high_count"]).where(f.is_problem("category")).withColumn("delta", F.col("after") - F.col("before")).where(F.col("delta") >= min_delta)

    now = snapshot_places.where(F.col("snapshot_id") == to_id).select("place_id", "category", F.col("complaint_count").alias("a"))
    then = snapshot_places.where(F.col("snapshot_id") == from_id).select("place_id", "category", F.col("complaint_count").alias("b"))
    grown = now.join(then, ["place_id", "category"], "full").fillna(0, ["a", "b"]).withColumn("gain", F.col("a") - F.col("b")).where("gain > 0")
    grown = grown.join(t.places.select(F.col("id").alias("place_id"), F.col("name").alias("place_name")), "place_id")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("gain"), "place_name"))
    leading = F.when(F.col("rank") <= 3, F.struct("rank", "place_name", F.col("gain").alias("delta")))
    where = grown.withColumn("rank", rank).groupBy("category").agg(
        F.count(F.lit(1)).alias("places_increased"), F.max("gain").alias("most"), F.sum("gain").alias("whole"), F.transform(F.array_sort(F.collect_list(leading)), lambda x: F.struct(x["place_name"].alias("place_name"), x["delta"].alias("delta"))).alias("top_places")
    )
    out = both.join(where, "category", "left").fillna(0, ["places_increased"])
    concentrated = (F.col("places_increased") == 1) | (F.col("most") / F.col("whole") >= 0.6)
    return out.select(
        "category",
        "before",
        "after",
        "delta",
        F.bround(F.try_divide(F.col("delta").cast("double"), F.col("before").cast("double")) * 100, 1).alias("pct_change"),
        "high_count",
        F.when(F.coalesce(concentrated, F.lit(False)), "concentrated").otherwise("widespread").alias("spread"),
        "places_increased",
        "top_places",
    ).orderBy(F.desc("delta"), "category")


def alerts(compared: DataFrame) -> DataFrame:
    """New categories, spikes in one place and broad increases, the most pressing first."""
    top = F.try_element_at("top_places", F.lit(1))
    kind = F.when((F.col("before") == 0) & (F.col("after") > 0), "new_category").when((F.col("spread") == "concentrated") & top.isNotNull(), "spike").otherwise("increase")
    large = F.col("delta") >= 5
    level = F.when(F.col("type") == "new_category", "high").when(F.col("type") == "spike", F.when(large, "high").otherwise("medium")).otherwise(F.when(large, "medium").otherwise("low"))
    grew = F.concat("category", F.lit(" เพิ่มขึ้น "), F.col("delta").cast("string"), F.lit(" คอมเมนต์"))
    title = F.when(F.col("type") == "new_category", F.concat(F.lit("ปัญหาใหม่: "), "category")).otherwise(grew)
    detail = (
        F.when(F.col("type") == "new_category", F.concat(F.lit("เพิ่งพบครั้งแรก "), F.col("after").cast("string"), F.lit(" คอมเมนต์")))
        .when(F.col("type") == "spike", F.concat(F.lit("กระจุกที่ร้านเดียว — "), top["place_name"], F.lit(" (+"), top["delta"].cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("กระจายใน "), F.col("places_increased").cast("string"), F.lit(" ร้าน — เป็นปัญหาภาพรวม")))
    )
    rows = compared.withColumn("type", kind).withColumns({"level": level, "title": title, "detail": detail}).withColumn("id", F.concat_ws(":", "type", "category"))
    rank = F.when(F.col("level") == "high", 0).when(F.col("level") == "medium", 1).otherwise(2)
    return rows.orderBy(rank, F.desc("delta"), "category")
