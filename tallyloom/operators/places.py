"""Place and review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import filters as f, geo, measures as m
from tallyloom.tables import Tables


def _counts(t: Tables) -> DataFrame:
    """Reviews and high severities of each place that has reviews."""
    return t.labelled("left").groupBy("place_id").agg(F.count(F.lit(1)).alias("review_count"), m.n_if(F.col("severity") == "high").alias("high_severity_count"))


def with_counts(t: Tables, places: DataFrame | None = None) -> DataFrame:
    """Places with their numbers of reviews and high severities, 0 if none."""
    rows = (t.places if places is None else places).join(_counts(t).withColumnRenamed("place_id", "id"), "id", "left")
    return rows.fillna(0, ["review_count", "high_severity_count"])


LISTED = ("id", "name", "search_query", "overall_rating", "scraped_at", "lng", "lat", "review_count", "high_severity_count")


def ordered(name: str = "name", collation: str | None = None) -> Column:
    """A name as it sorts and compares: by code points, or under an ICU collation.

    ``th`` is the order of Thai dictionaries, where a vowel that is written before its consonant
    sorts after it; with ``_CI`` and ``_AI`` case and accents don't count, in equality too.
    """
    return F.col(name) if collation is None else F.collate(name, collation)


def list_places(t: Tables, limit=100, offset=0, collation: str | None = None) -> DataFrame:
    """A page of places in order of their names, under a collation if one is named."""
    order = (ordered("name", collation), "id")
    page = t.places.orderBy(*order).offset(offset).limit(min(limit, 500))
    # Rows of a page are numbered, as sorting them alike once more may be left out as done.
    page = page.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return with_counts(t, page).orderBy("_n").select(*LISTED)


def named(t: Tables, name: str, collation: str = "th_CI") -> DataFrame:
    """Places whose name is equal to ``name`` under a collation."""
    return t.places.where(ordered("name", collation) == F.collate(F.lit(name), collation))


def same_names(t: Tables, collation: str = "th_CI") -> DataFrame:
    """Names that several places have under a collation: how many places, and in how many spellings."""
    # A grouped collated name stands for any of its spellings: the least by code points is told.
    rows = t.places.where("name IS NOT NULL").groupBy(ordered("name", collation).alias("_same"))
    return rows.agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n_places"), F.count_distinct("name").alias("n_spellings")).where("n_places > 1").drop("_same")


def nearest_to_campus(t: Tables, k=5, campus: str = "nu") -> DataFrame:
    """The places nearest to a campus (``nu`` or ``psru``), with their distances to both in km."""
    nu, psru = geo.campus_distances(F.col("lat"), F.col("lng"))
    rows = t.places.select("id", "name", "zone", nu.alias("distance_nu_km"), psru.alias("distance_psru_km")).where(F.col(f"distance_{campus}_km").isNotNull())
    return rows.orderBy(f"distance_{campus}_km", "id").limit(k)


def get_place(t: Tables, place_id: int) -> DataFrame:
    return with_counts(t, t.places.where(F.col("id") == place_id)).select(*LISTED)


def nearby(t: Tables, lat: float, lng: float, radius: float = 5000, limit=20) -> DataFrame:
    """Places within a radius in metres on the spheroid (100 to 100,000), nearest first; a box goes before the distance."""
    radius = max(100.0, min(float(radius), 100_000.0))
    dlat = radius / 110_000.0
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lng").isNotNull()
    rows = t.places.where(box).withColumn("distance_m", geo.geodesic(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))).where(F.col("distance_m") <= radius)
    nearest = rows.orderBy("distance_m", "id").limit(limit).withColumn("_n", F.row_number().over(Window.orderBy("distance_m", "id")))
    return with_counts(t, nearest).orderBy("_n").select("id", "name", "overall_rating", "lng", "lat", "distance_m", "review_count", "high_severity_count")


def place_pain_points(t: Tables, place_id: int, view="all", date_from=None, date_to=None, with_text_only=False) -> DataFrame:
    wanted = f.all_of(F.col("place_id") == place_id, f.view_is(view), f.in_period(date_from, date_to), f.has_text() if with_text_only else None)
    return t.labelled().where(wanted).groupBy(F.col("pain_point_category").alias("category"), "severity").agg(F.count(F.lit(1)).alias("count"))


def _listing(t: Tables, category=None, severity=None, place_id=None, date_from=None, date_to=None, view="all", status="all") -> DataFrame:
    equal = lambda column, value: None if value is None else F.col(column) == value
    return t.star("left").where(f.all_of(equal("place_id", place_id), equal("pain_point_category", category), equal("severity", severity), f.in_period(date_from, date_to), f.view_is(view), f.status_is(status)))


def review_totals(t: Tables, **filters) -> DataFrame:
    """Reviews to show, and those hidden because they have no text."""
    return _listing(t, **filters).agg(m.n_if(f.has_text()).alias("total"), m.n_if(~f.has_text()).alias("hidden_no_text"))



def _item(rows: DataFrame) -> DataFrame:
    return rows.select("id", "place_id", "place_name", "rating", F.col("text_clean").alias("text"), "review_date", "review_date_approx", "sentiment", F.col("pain_point_category").alias("category"), "severity", "keywords")


def list_reviews(t: Tables, page=1, page_size=20, **filters) -> DataFrame:
    """A page of reviews with text: worst first, then the latest."""
    rows = _listing(t, **filters).where(f.has_text()).orderBy(m.severity_rank(), F.desc_nulls_last("review_date_approx"), F.desc("id"))
    return _item(rows.offset((page - 1) * page_size).limit(min(page_size, 100)))


def place_reviews(t: Tables, place_id: int, severity=None, category=None, limit=20, offset=0) -> DataFrame:
    return _item(_listing(t, place_id=place_id, severity=severity, category=category).orderBy(F.desc("id")).offset(offset).limit(limit))


def jobs(log: DataFrame, limit=20) -> DataFrame:
    """The last state of each job, latest first."""
    last = log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), F.struct("finished_at", "started_at", "status")).alias("s")).select("id", "s.*")
    return last.orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(limit)


def job_started(log: DataFrame, job_id: int, job_type: str, at) -> DataFrame:
    """A log with the row of a job that begins; logs only grow, and a job's last row is its state."""
    row = log.sparkSession.range(1).select(F.lit(job_id).alias("id"), F.lit(job_type).alias("job_type"), F.lit("running").alias("status"), F.lit(at).alias("started_at"))
    return _logged(log, row)


def job_ended(log: DataFrame, job_id: int, at, places_count=None, reviews_count=None, error: str | None = None) -> DataFrame:
    """A log with the row of a job that is done, or failed with ``error``; type and start come from its first row."""
    first = log.where(F.col("id") == job_id).groupBy("id").agg(F.min("job_type").alias("job_type"), F.min("started_at").alias("started_at"))
    row = first.select("id", "job_type", F.lit("done" if error is None else "failed").alias("status"), "started_at", F.lit(at).alias("finished_at"), F.lit(places_count).alias("places_count"), F.lit(reviews_count).alias("reviews_count"), F.lit(error).alias("error"))
    return _logged(log, row)


def _logged(log: DataFrame, row: DataFrame) -> DataFrame:
    kinds = dict(log.dtypes)
    have = [F.col(c).cast(kinds[c]).alias(c) if c in row.columns else F.lit(None).cast(kinds[c]).alias(c) for c in log.columns]
    return log.unionByName(row.select(*have))


def ranked_by(rows: DataFrame, measure: Column, k=20) -> DataFrame:
    """Rows with a positive measure, the largest first."""
    return rows.withColumn("_measure", measure).where("_measure > 0").orderBy(F.desc("_measure"), *rows.columns[:1]).limit(k).drop("_measure")
