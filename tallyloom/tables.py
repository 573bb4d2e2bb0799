"""The review domain's tables and schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

REVIEW = T.StructType([T.StructField("rating", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("date", T.StringType())])
#: One element of a landing file: a place with its reviews.
LANDING = T.StructType(
    [
        T.StructField("place_name", T.StringType()),
        T.StructField("search_query", T.StringType()),
        T.StructField("overall_rating", T.StringType()),
        T.StructField("google_category", T.StringType()),
        T.StructField("opening_hours", T.StringType()),
        T.StructField("price_level", T.StringType()),
        T.StructField("business_status", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("reviews", T.ArrayType(REVIEW)),
        T.StructField("scraped_at", T.TimestampType()),
    ]
)
PLACES = """id long, name string, search_query string, overall_rating double, lat double, lng double, zone string, google_category string, business_status string,
opening_hours string, price_level string, distance_nu_km double, distance_psru_km double, scraped_at timestamp"""
REVIEWS = "id long, place_id long, rating int, text string, text_clean string, text_hash string, review_date string, review_date_approx date, scraped_at timestamp"
ANALYZED = "id long, review_id long, sentiment string, pain_point_category string, severity string, keywords array<string>, analyzed_at timestamp, model_used string"
SNAPSHOTS = "id long, taken_at timestamp, period_label string, total_places long, total_reviews long, total_analyzed long, note string"


@dataclass
class Tables:
    """The domain's tables; any of them may come from elsewhere."""

    places: DataFrame
    reviews: DataFrame
    analyzed: DataFrame
    candidates: DataFrame | None = None
    cells: DataFrame | None = None

    def labelled(self, how: str = "inner") -> DataFrame:
        """Reviews with their labels (``left`` keeps those without): label id is analysis_id."""
        own = self.analyzed.select(*(c for c in self.analyzed.columns if c not in ("id", "review_id")), self.analyzed["id"].alias("analysis_id"), self.analyzed["review_id"].alias("id"))
        return self.reviews.join(own, "id", how)

    def star(self, how: str = "inner") -> DataFrame:
        """Labelled reviews with their places' columns; place columns that clash begin with place_."""
        place = self.places.select(self.places["id"].alias("place_id"), self.places["name"].alias("place_name"), self.places["scraped_at"].alias("place_scraped_at"), *(c for c in self.places.columns if c not in ("id", "name", "scraped_at")))
        return self.labelled(how).join(place, "place_id")




def read(spark: SparkSession, folder: str) -> Tables:
    """Tables kept as Parquet below one folder."""
    at = {name: spark.read.parquet(f"{folder}/{name}") for name in ("places", "reviews", "analyzed_reviews")}
    return Tables(at["places"], at["reviews"], at["analyzed_reviews"])
