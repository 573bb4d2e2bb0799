"""Landing files: nested place and review JSON in, merged master files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.functions import dates, text as x
from tallyloom.operators import upserts
from tallyloom.tables import LANDING


def read(spark: SparkSession, path: str, multi_line=True) -> DataFrame:
    """Entries of landing files: one array a file, or one object a line."""
    return spark.read.schema(LANDING).option("multiLine", multi_line).json(path)


def reviews(entries: DataFrame) -> DataFrame:
    """One row a review: place, rating, cut and cleaned text, hash, date and its day.

    Raw texts of fewer than five characters are no reviews; at most 1000 characters are kept.
    """
    rows = entries.where(upserts.is_valid_place()).select("place_name", "scraped_at", F.posexplode("reviews").alias("pos", "r"))
    raw = F.substring("r.text", 1, 1000)
    rows = rows.where(F.length(x.strip(F.coalesce("r.text", F.lit("")))) >= 5)
    return rows.select(
        "place_name",
        "pos",
        F.col("r.rating").alias("rating"),
        raw.alias("text"),
        F.substring(x.clean_review_text(F.col("r.text")), 1, 1000).alias("text_clean"),
        x.review_text_hash(F.col("r.text")).alias("text_hash"),
        F.col("r.date").alias("review_date"),
        dates.relative_date(F.col("r.date"), F.col("scraped_at").cast("date")).alias("review_date_approx"),
        "scraped_at",
    )


def first_copies(rows: DataFrame, key=("place_name", "text_hash"), order="pos") -> DataFrame:
    """The first review of each place and hash."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def merge_master(master: DataFrame, fresh: DataFrame) -> DataFrame:
    """One entry a place: new reviews are added unless their text is known; coordinates fill gaps.

    Both are landing entries; invalid places among the fresh ones go.
    """
    tagged = master.withColumn("_from", F.lit(0)).unionByName(fresh.where(upserts.is_valid_place()).withColumn("_from", F.lit(1)), allowMissingColumns=True)
    each = tagged.select("place_name", "_from", "scraped_at", F.posexplode("reviews").alias("_pos", "review")).withColumn("_hash", x.review_text_hash(F.col("review.text")))
    order = Window.partitionBy("place_name", "_hash").orderBy("_from", "scraped_at", "_pos")
    # Reviews of the master stay as they are; an empty text is never a new review.
    kept = each.withColumn("_n", F.row_number().over(order)).where((F.col("_from") == 0) | ((F.col("_n") == 1) & (x.strip(F.coalesce("review.text", F.lit(""))) != "")))
    gathered = kept.groupBy("place_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_from", "scraped_at", "_pos", "review"))), lambda r: r["review"]).alias("reviews"))
    others = [c for c in master.columns if c not in ("place_name", "reviews", "scraped_at", "lat", "lng")]
    first = F.struct("_from", "scraped_at")
    with_place = F.when(F.col("lat").isNotNull(), F.struct("_from", "scraped_at"))
    entries = tagged.groupBy("place_name").agg(*(F.min_by(c, first).alias(c) for c in others), F.min_by("lat", with_place).alias("lat"), F.min_by("lng", with_place).alias("lng"), F.max("scraped_at").alias("scraped_at"))
    return entries.join(gathered, "place_name", "left").select(*master.columns)


def checked(lines: DataFrame, column="value") -> DataFrame:
    """Lines of landing files as ``(raw, entry, reason)``: a VARIANT, and why it is no entry (null if it is one).

    json: not JSON, as after a write that broke off; object: something else than an object; name:
    no name; reviews: no array of objects; number: a coordinate that is none.
    """
    rows = lines.select(F.col(column).alias("raw"), F.try_parse_json(column).alias("entry"))
    part = lambda path, kind: F.try_variant_get("entry", path, kind)
    there = lambda path: ~F.is_variant_null(part(path, "variant")) & part(path, "variant").isNotNull()
    reviews = part("$.reviews", LANDING["reviews"].dataType.simpleString())
    is_object = F.schema_of_variant("entry").startswith("OBJECT")
    bad_number = lambda path: there(path) & part(path, "double").isNull()
    reason = (
        F.when(F.col("entry").isNull(), "json")
        .when(~F.coalesce(is_object, F.lit(False)), "object")
        .when(F.coalesce(F.trim(part("$.place_name", "string")), F.lit("")) == "", "name")
        .when(F.coalesce(there("$.reviews"), F.lit(False)) & (reviews.isNull() | F.exists(reviews, lambda r: r.isNull())), "reviews")
        .when(F.coalesce(bad_number("$.lat") | bad_number("$.lng"), F.lit(False)), "number")
    )
    return rows.withColumn("reason", reason)


def sound(rows: DataFrame) -> DataFrame:
    """Entries of :func:`checked` lines without a reason against them; fields of the wrong kind are null."""
    return rows.where("reason IS NULL").select(*(F.try_variant_get("entry", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in LANDING.fields))


def count_differences(entries: DataFrame, places: DataFrame, reviews: DataFrame) -> DataFrame:
    """Places whose entries hold another number of distinct reviews than the tables, the largest difference first."""
    told = entries.select("place_name", F.explode("reviews").alias("r")).groupBy("place_name").agg(F.count_distinct(x.review_text_hash(F.col("r.text"))).alias("landed"))
    held = reviews.groupBy(F.col("place_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(places.select("id", F.col("name").alias("place_name")), "id")
    stored = held.groupBy("place_name").agg(F.sum("n").alias("stored"))
    # As in a report from the tables' side: places that have no review there aren't told.
    rows = stored.join(told, "place_name", "left").fillna(0, ["landed"]).withColumn("difference", F.col("landed") - F.col("stored"))
    return rows.where("difference != 0").orderBy(F.desc(F.abs("difference")), "place_name")


def write_master(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved answers of a place API as candidates, and whether a search hit its cap of 60.

    Each line: {cell_lat, cell_lng, cell_radius_m, place_type, results: [{place_id, name, lat, lng, types, rating, user_ratings_total, business_status, vicinity}]}.
    """
    item = "struct<place_id:string,name:string,lat:double,lng:double,types:array<string>,rating:double,user_ratings_total:int,business_status:string,vicinity:string>"
    rows = spark.read.schema(f"cell_lat double, cell_lng double, cell_radius_m int, place_type string, results array<{item}>").json(path)
    one = rows.select("cell_lat", "cell_lng", "place_type", (F.size("results") >= 60).alias("hit_cap"), F.explode("results").alias("r"))
    status = F.create_map(*(F.lit(v) for pair in {"OPERATIONAL": "operational", "CLOSED_TEMPORARILY": "closed_temporarily", "CLOSED_PERMANENTLY": "closed_permanently"}.items() for v in pair))
    return one.select(
        F.col("r.place_id").alias("google_place_id"),
        "r.name",
        "r.lat",
        "r.lng",
        F.array_join("r.types", ",").alias("google_types"),
        F.col("r.rating").alias("google_rating"),
        F.col("r.user_ratings_total").alias("google_reviews_total"),
        F.try_element_at(status, F.col("r.business_status")).alias("business_status"),
        "r.vicinity",
        F.col("place_type").alias("source_type"),
        F.array_contains("r.types", F.col("place_type")).alias("type_matches"),
        "hit_cap",
    )
