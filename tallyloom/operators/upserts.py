"""Upserts, moves and state changes as new versions of tables.

Parquet has no updates: each function returns the table after the change, to be written
beside the old one and swapped in (:mod:`tallyloom.sources.versions`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions import geo, text as x
from tallyloom.sources.scratch import cut


def next_ids(rows: DataFrame, existing: DataFrame, order: list[str], column="id") -> DataFrame:
    """Rows numbered on from the greatest id, in a fixed order.

    Ranges are sorted in parallel and numbered by each partition's offset.  The sorted rows
    are written once, as both the offsets and the numbers must see the same partitions.
    """
    start = existing.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("_start"))
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition.
    ahead = sizes.withColumn("_ahead", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_ahead")
    numbered = placed.join(ahead, "_part").crossJoin(start)
    return numbered.withColumn(column, F.col("_start") + F.col("_ahead") + F.col("_place") + 1).drop("_at", "_part", "_place", "_ahead", "_start")


def upsert(old: DataFrame, new: DataFrame, key: list[str], prefer_old: tuple[str, ...] = (), keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with new values where these aren't null, and new rows.

    ``prefer_old`` columns change only where they were null; ``keep_old`` never change.
    """
    columns = [c for c in old.columns if c not in key]
    fresh = new.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns if c in new.columns), F.lit(True).alias("_is_new"))
    rows = old.withColumn("_is_old", F.lit(True)).join(fresh, key, "full")

    def value(c: str):
        if c not in new.columns:
            return F.col(c)
        if c in keep_old:
            return F.when(F.col("_is_old"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        return F.coalesce(*((c, f"_new_{c}") if c in prefer_old else (f"_new_{c}", c)))

    return rows.select(*key, *(value(c).alias(c) for c in columns)).select(*old.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], first_by: str | None = None) -> DataFrame:
    """New rows whose key is not there yet, one a key."""
    fresh = new.join(existing.select(*key), key, "left_anti")
    if first_by is None:
        return fresh.dropDuplicates(key)
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(first_by))).where("_n = 1").drop("_n")


def seen_again(old: DataFrame, new: DataFrame, now) -> DataFrame:
    """Candidates after a search: last_seen_at and seen_count grow, the first source stays."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("google_place_id").orderBy(*[c for c in new.columns if c != "google_place_id"]))).where("_n = 1").drop("_n")
    counted = new.groupBy("google_place_id").agg(F.count(F.lit(1)).alias("seen_count"))
    stamped = first.join(counted, "google_place_id").withColumns({"first_seen_at": F.lit(now), "last_seen_at": F.lit(now)})
    before = old.select("google_place_id", F.col("seen_count").alias("_seen"))
    stamped = stamped.join(before, "google_place_id", "left").withColumn("seen_count", F.col("seen_count") + F.coalesce("_seen", F.lit(0))).drop("_seen")
    return upsert(old, stamped, ["google_place_id"], keep_old=("first_seen_at", "source_type", "source_cell"))


def last_write(log: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def scan_stats(places: DataFrame, reviews: DataFrame, scanned: DataFrame) -> DataFrame:
    """After a scan of the named places: new reviews since the last, and the run of scans without any."""
    held = reviews.groupBy(F.col("place_id").alias("id")).agg(F.count(F.lit(1)).alias("_cnt"))
    mine = scanned.select("name").distinct().withColumn("_mine", F.lit(True))
    rows = places.join(held, "id", "left").join(mine, "name", "left").fillna(0, ["_cnt"])
    last = F.coalesce("last_review_count", F.lit(0))
    grew = F.col("_cnt") > last
    return rows.withColumns(
        {
            "last_scan_new_reviews": F.when(F.col("_mine"), F.greatest(F.col("_cnt") - last, F.lit(0))),
            "consecutive_no_change": F.when(F.col("_mine"), F.when(grew, 0).otherwise(F.coalesce("consecutive_no_change", F.lit(0)) + 1)).otherwise(F.col("consecutive_no_change")),
            "last_review_count": F.when(F.col("_mine"), F.col("_cnt")).otherwise(F.col("last_review_count")),
        }
    ).drop("_cnt", "_mine")


def scan_failures(places: DataFrame, attempted: DataFrame, served: DataFrame, most=3) -> DataFrame:
    """Attempted places that were not served fail once more and are given up at ``most``; served ones start anew."""
    asked = attempted.select("name").distinct().withColumn("_asked", F.lit(True))
    got = served.select("name").distinct().withColumn("_got", F.lit(True))
    rows = places.join(asked, "name", "left").join(got, "name", "left")
    failed = F.coalesce("refresh_shortfalls", F.lit(0)) + 1
    now = F.when(F.col("_got"), 0).when(F.col("_asked"), failed).otherwise(F.col("refresh_shortfalls"))
    return rows.withColumn("refresh_shortfalls", now).withColumn("given_up", F.coalesce(F.col("refresh_shortfalls") >= most, F.lit(False))).drop("_asked", "_got")


def backup_rows(arrays: DataFrame) -> DataFrame:
    """Rows (id, value) of a backup file that holds parallel arrays (ids, values)."""
    return arrays.select(F.inline(F.arrays_zip("ids", "values"))).withColumnsRenamed({"ids": "id", "values": "value"})


def restore(table: DataFrame, key: str, column: str, backup: DataFrame) -> DataFrame:
    """A column set from backup rows (id, value)."""
    pairs = backup.select(F.col("id").alias(key), F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    return table.join(pairs, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))).select(*table.columns)


def place_rows(landing: DataFrame) -> DataFrame:
    """Places of landing entries with zone and campus distances; invalid ones go."""
    nu, psru = geo.campus_distances(F.col("lat"), F.col("lng"))
    valid = landing.where(is_valid_place())
    rows = valid.select(
        F.col("place_name").alias("name"), "search_query", x.parse_rating(F.col("overall_rating")).alias("overall_rating"), "lat", "lng", geo.assign_zone(F.col("lat"), F.col("lng")).alias("zone"), "google_category", "business_status", "opening_hours", "price_level", nu.alias("distance_nu_km"), psru.alias("distance_psru_km"), "scraped_at"
    )
    return last_write(rows, ["name"], "scraped_at")


#: Words of the page around a place that are no names (fixed values).
UI_NAMES = ("ผลลัพธ์", "แผนที่", "ภาพรวม", "รีวิว", "ใกล้เคียง", "ค้นหา", "เส้นทาง")


def is_valid_place():
    """A name of more than three characters that is no heading, inside the province."""
    name = F.coalesce("place_name", F.lit(""))
    return (F.length(name) > 3) & ~name.isin(*UI_NAMES) & geo.in_province(F.col("lat"), F.col("lng"))
