"""Incremental ingest of landing files, and labelling of what has no label yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.functions import text as x
from tallyloom.operators import upserts
from tallyloom.sources import landing, versions
from tallyloom.sources.scratch import cut
from tallyloom.tables import LANDING, PLACES, REVIEWS


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema) if versions.current(spark, folder) is None else versions.read(spark, folder)


def ingest_batch(spark: SparkSession, entries: DataFrame, folder: str) -> None:
    """Upsert the places of landing entries and insert reviews whose (place, hash) is new.

    Runs again without effect: known keys are left out by an anti join with two columns of
    the table, so no stream state grows with the reviews.  New reviews are appended as one
    part; places, a few for thousands of reviews, are written anew where entries change them.
    """
    places = _table(spark, f"{folder}/places", PLACES)
    fresh = cut(upserts.place_rows(entries))  # else the entries are read for each use
    newcomers = upserts.next_ids(fresh.join(places.select("name"), "name", "left_anti").select("name"), places, ["name"])
    known = places.select("id", "name").unionByName(newcomers.select("id", "name"))
    columns = [c for c in places.columns if c in fresh.columns and c not in ("id", "name")]
    merged = upserts.upsert(places, fresh.join(known, "name").select("id", "name", *columns), ["id", "name"])
    versions.write(merged.select(*places.columns), f"{folder}/places")
    places = versions.read(spark, f"{folder}/places")

    reviews = _table(spark, f"{folder}/reviews", REVIEWS)
    rows = landing.reviews(entries).join(places.select(F.col("id").alias("place_id"), F.col("name").alias("place_name")), "place_name")
    rows = landing.first_copies(rows, ("place_id", "text_hash"), "scraped_at").join(reviews.select("place_id", "text_hash"), ["place_id", "text_hash"], "left_anti")
    numbered = upserts.next_ids(rows, reviews, ["place_id", "text_hash"])
    versions.append(numbered.select(*reviews.columns), f"{folder}/reviews")


def ingest(spark: SparkSession, source: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in all landing files that have come since the last run (one entry a line)."""
    stream = spark.readStream.schema(LANDING).json(source)
    return stream.writeStream.foreachBatch(lambda df, _: ingest_batch(df.sparkSession, df, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


QUARANTINE = "batch long, raw string, reason string"


def ingest_checked_batch(spark: SparkSession, lines: DataFrame, folder: str, batch: int) -> None:
    """Entries of sound lines go into the tables, the other lines with their reasons into a quarantine table.

    A batch that runs again adds nothing: the quarantine knows the batches it has.
    """
    rows = cut(landing.checked(lines))
    ingest_batch(spark, landing.sound(rows), folder)
    held = _table(spark, f"{folder}/quarantine", QUARANTINE)
    if held.where(F.col("batch") == batch).isEmpty():
        versions.append(rows.where("reason IS NOT NULL").select(F.lit(batch).cast("long").alias("batch"), "raw", "reason"), f"{folder}/quarantine")


def ingest_checked(spark: SparkSession, source: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Like :func:`ingest`, for files that may hold broken lines: none of them stops a batch."""
    stream = spark.readStream.text(source)
    return stream.writeStream.foreachBatch(lambda df, batch: ingest_checked_batch(df.sparkSession, df, folder, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unlabelled_after(reviews: DataFrame, labels: DataFrame, delay: str = "2 days", late: str = "1 day") -> DataFrame:
    """Reviews of a stream that got no label of another stream within ``delay`` after they were scraped.

    An outer join of streams: both sides are kept only as long as the other's watermark may still
    bring a partner, so its state is what came within ``late`` and ``delay``.
    """
    left = reviews.withWatermark("scraped_at", late)
    right = labels.select("review_id", "analyzed_at").withWatermark("analyzed_at", late)
    near = (F.col("id") == F.col("review_id")) & F.col("analyzed_at").between(F.col("scraped_at"), F.col("scraped_at") + F.expr(f"INTERVAL {delay}"))
    return left.join(right, near, "left_outer").where("review_id IS NULL").select(*reviews.columns)


def rule_labels(reviews: DataFrame) -> DataFrame:
    """Labels by stars and words."""
    text = F.coalesce("text_clean", F.lit(""))
    category = F.when(text != "", F.get(x.rule_categories(text), 0))
    return reviews.select(F.col("id").alias("review_id"), x.sentiment_from_rating(F.col("rating")).alias("sentiment"), category.alias("pain_point_category"), x.severity_from_rating(F.col("rating")).alias("severity"), x.keywords(text).alias("keywords"), F.lit("rules").alias("model_used"))


def unlabelled(reviews: DataFrame, analyzed: DataFrame) -> DataFrame:
    return reviews.join(analyzed.select(F.col("review_id").alias("id")), "id", "left_anti")


def label_new(reviews: DataFrame, analyzed: DataFrame, classify: Callable[[DataFrame], DataFrame] = rule_labels) -> DataFrame:
    """Labels of reviews that have none; ``classify`` may run a model (in mapInPandas) instead of the rules.

    A classifier may leave reviews out; those fall back to the rules.
    """
    todo = unlabelled(reviews, analyzed)
    first = classify(todo)
    if classify is rule_labels:
        return first
    rest = todo.join(first.select(F.col("review_id").alias("id")), "id", "left_anti")
    return first.unionByName(rule_labels(rest), allowMissingColumns=True)


def relabel(analyzed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Labels written anew; columns that the fresh ones lack (a teacher's labels) stay."""
    return upserts.upsert(analyzed, fresh, ["review_id"])
