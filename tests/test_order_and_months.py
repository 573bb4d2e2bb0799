"""Names under a collation, the job log, snapshots of all months, sketches of days and count differences."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import places, snapshots
from tallyloom.sources import landing
from tallyloom.tables import LANDING, Tables


def listed(spark, names):
    rows = spark.createDataFrame([(i, n, None, None, None, 1.0, 1.0) for i, n in enumerate(names)], "id long, name string, search_query string, overall_rating double, scraped_at date, lng double, lat double")
    reviews = spark.createDataFrame([], "id long, place_id long")
    return Tables(rows, reviews, spark.createDataFrame([], "id long, review_id long, severity string"))


def test_thai_order(spark):
    # A leading vowel sorts after its consonant; tone marks count last.
    right = ["กา", "ก้า", "เกา", "เก่า", "แก", "ไก่", "ขา", "เข้า", "โขน", "คน", "เธอ", "อา", "แอ", "ฮา"]
    mixed = right[:]
    random.Random(4).shuffle(mixed)
    got = [r["name"] for r in places.list_places(listed(spark, mixed), collation="th").collect()]
    assert got == right
    assert [r["name"] for r in places.list_places(listed(spark, mixed)).collect()] == sorted(mixed) != right
    assert [r["name"] for r in places.list_places(listed(spark, mixed), limit=3, offset=2, collation="th").collect()] == right[2:5]


def test_nearest_first(spark):
    names = [f"p{i}" for i in range(12)]
    t = listed(spark, names)
    far = {n: (7 * i) % 12 for i, n in enumerate(names)}
    away = F.create_map(*(F.lit(x) for n in names for x in (n, far[n])))
    t.places = t.places.withColumn("lat", 16.8 + 0.001 * away[F.col("name")]).withColumn("lng", F.lit(100.2))
    got = [r["name"] for r in places.nearby(t, 16.8, 100.2, limit=9).collect()]
    assert got == sorted(names, key=far.get)[:9]


def test_equal_under_a_collation(spark):
    t = listed(spark, ["Cafe ก", "CAFE ก", "Café ก", "cafe ข", None, "คน", "คน"])
    assert sorted(r["name"] for r in places.named(t, "cafe ก").collect()) == ["CAFE ก", "Cafe ก"]
    assert sorted(r["name"] for r in places.named(t, "cafe ก", "th_CI_AI").collect()) == ["CAFE ก", "Cafe ก", "Café ก"]
    assert sorted(tuple(r) for r in places.same_names(t).collect()) == [("CAFE ก", 2, 2), ("คน", 2, 1)]


def test_job_log(spark):
    log = spark.createDataFrame([], "id long, job_type string, status string, started_at timestamp, finished_at timestamp, places_count long, reviews_count long, error string")
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    log = places.job_started(log, 1, "discover", at(1))
    log = places.job_started(log, 2, "refresh", at(2))
    log = places.job_started(places.job_ended(log, 1, at(3), 7, 90), 3, "deep", at(4))
    log = places.job_ended(log, 2, at(5), error="blocked")
    log = places.job_ended(log, 9, at(5))  # a job that never began
    got = {r["id"]: r for r in places.jobs(log).collect()}
    assert {k: (r["job_type"], r["status"], r["started_at"], r["finished_at"], r["places_count"], r["reviews_count"], r["error"]) for k, r in got.items()} == {
        1: ("discover", "done", at(1), at(3), 7, 90, None),
        2: ("refresh", "failed", at(2), at(5), None, None, "blocked"),
        3: ("deep", "running", at(4), None, None, None, None),
    }


@pytest.fixture(scope="module")
def star(spark):
    pick = random.Random(8)
    day = lambda: pick.choice([None, *(datetime.date(2020, 1, 30) + datetime.timedelta(days=17 * k) for k in range(20))])
    reviews = [(i, pick.randint(1, 5), pick.choice(["text", "text", "", None]), day()) for i in range(300)]
    labels = [(i, i, pick.choice(["positive", "negative", None]), pick.choice(["a", "b", None]), pick.choice(["high", "medium", "low"])) for i in range(290)]
    return Tables(
        spark.createDataFrame([(1, "p1", "z1", None), (2, "p2", "z2", None), (3, "p3", None, None), (4, "p4", "z1", None)], "id long, name string, zone string, scraped_at date"),
        spark.createDataFrame(reviews, "id long, place_id long, text_clean string, review_date_approx date"),
        spark.createDataFrame(labels, "id long, review_id long, sentiment string, pain_point_category string, severity string"),
    )


def test_each_month_is_a_snapshot(spark, star):
    columns = ["zone", "category", "complaint_count", "praise_count", "high_count", "medium_count", "low_count"]
    got = {}
    for r in snapshots.monthly_categories(star).collect():
        got.setdefault(r["as_of"], []).append(tuple(r[c] for c in columns))
    assert len(got) >= 11
    for as_of, rows in got.items():
        want = [tuple(r) for r in snapshots.categories(star, 1, as_of).select(*columns).collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_no_reviews_no_months(spark, star):
    none = Tables(star.places, star.reviews.limit(0), star.analyzed)
    assert snapshots.monthly_categories(none).count() == 0


def test_sketches_unite(spark):
    rows = spark.range(60_000).select((F.col("id") % 9_000).alias("who"), F.expr("date_add(DATE '2024-01-01', cast(id % 30 as int))").alias("day"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("zone"))
    kept = snapshots.daily_sketches(rows, "day", ["zone"], "who").persist()
    for low, high in ((None, None), (datetime.date(2024, 1, 5), datetime.date(2024, 1, 9)), (datetime.date(2024, 1, 30), None)):
        wanted = F.lit(True) if low is None else F.col("day") >= F.lit(low)
        wanted = wanted & (F.lit(True) if high is None else F.col("day") <= F.lit(high))
        exact = {r["zone"]: r["n"] for r in rows.where(wanted).groupBy("zone").agg(F.count_distinct("who").alias("n")).collect()}
        got = {r["zone"]: r["n"] for r in snapshots.distinct_in(kept, ["zone"], low, high).collect()}
        assert got.keys() == exact.keys() and all(abs(got[z] - n) <= 3 * 1.04 / 64 * n for z, n in exact.items())
    assert snapshots.distinct_in(kept, ["zone"], datetime.date(2030, 1, 1)).count() == 0


def test_count_differences(spark):
    def entry(name, texts):
        return (name, None, None, None, None, None, None, None, None, [(5, t, None) for t in texts], None)

    entries = spark.createDataFrame([entry("same", ["one text here", "two texts here"]), entry("less", ["one text here"] * 3), entry("more", ["text a b c", "text d e f", "text g h i"]), entry("new", ["only landed"])], LANDING)
    names = spark.createDataFrame([(1, "same"), (2, "less"), (3, "more"), (4, "gone"), (5, "none")], "id long, name string")
    reviews = spark.createDataFrame([(p,) for p, n in ((1, 2), (2, 3), (3, 2), (4, 1)) for _ in range(n)], "place_id long")
    assert [tuple(r) for r in landing.count_differences(entries, names, reviews).select("place_name", "landed", "stored", "difference").collect()] == [("less", 1, 3, -2), ("gone", 0, 1, -1), ("more", 3, 2, 1)]
