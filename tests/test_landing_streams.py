"""Broken landing lines in a stream, and labels that meet reviews as streams."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.sources import landing, scratch, versions
from tallyloom.streaming import ingest

GOOD = {"place_name": "A fine place", "lat": 16.8, "lng": 100.2, "scraped_at": "2024-01-01T00:00:00", "reviews": [{"rating": 5, "text": "good food here", "date": "a week ago"}, {"rating": "4", "text": "nice and clean", "extra": {"deep": 1}}]}


def line(**changes):
    return json.dumps({**GOOD, **changes}, ensure_ascii=False)


BROKEN = {
    "json": [line()[:80], "{", "", '{"place_name": "x"'],
    "object": ["[]", "12", "null", '"text"', json.dumps([GOOD])],
    "name": [line(place_name=None), line(place_name="  "), json.dumps({"reviews": []})],
    "reviews": [line(reviews="none"), line(reviews=[1, 2]), line(reviews={})],
    "number": [line(lat="north"), line(lng=[1])],
}
SOUND = [line(), line(place_name="ร้านกาแฟ", lat="16.81"), line(place_name="No reviews", reviews=None), line(place_name="Nowhere", lat=None, lng=None, reviews=[{"rating": "many"}])]


def test_reasons(spark):
    rows = spark.createDataFrame([(x, None) for x in SOUND] + [(x, k) for k, xs in BROKEN.items() for x in xs], "value string, want string")
    got = landing.checked(rows).join(rows, F.col("raw") == F.col("value"))
    assert [(r["raw"], r["reason"], r["want"]) for r in got.collect() if r["reason"] != r["want"]] == []
    sound = {r["place_name"]: r for r in landing.sound(landing.checked(rows)).collect()}
    assert set(sound) == {"A fine place", "ร้านกาแฟ", "No reviews", "Nowhere"}
    assert sound["ร้านกาแฟ"]["lat"] == 16.81 and sound["No reviews"]["reviews"] is None
    assert [(r["rating"], r["text"]) for r in sound["A fine place"]["reviews"]] == [(5, "good food here"), (4, "nice and clean")]


def test_no_line_stops_a_batch(spark):
    at = scratch.folder(spark, "quarantine-test")
    every = [x for xs in BROKEN.values() for x in xs]
    files = [SOUND[:2] + every[:5], every[5:12], SOUND[2:] + every[12:]]
    assert sum(map(len, files)) == len(SOUND) + len(every)
    for k, lines in enumerate(files):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{at}/in/b={k}")
        ingest.ingest_checked(spark, f"{at}/in/*", f"{at}/db", f"{at}/checkpoint").awaitTermination()
    kept = versions.read(spark, f"{at}/db/quarantine").collect()
    assert sorted(r["raw"] for r in kept) == sorted(every)
    assert versions.read(spark, f"{at}/db/places").count() == len(SOUND)
    again = spark.createDataFrame([(x,) for x in files[1]], "value string")
    ingest.ingest_checked_batch(spark, again, f"{at}/db", kept[0]["batch"])
    assert versions.read(spark, f"{at}/db/quarantine").count() == len(every)


def test_unlabelled_after_a_delay(spark):
    at = scratch.folder(spark, "unlabelled-test")
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    reviews = [(1, day(0)), (2, day(0)), (3, day(1)), (4, day(2)), (5, day(30))]
    labels = [(1, day(1)), (2, day(5)), (3, day(0)), (5, day(31))]
    batches = [([r], []) for r in reviews] + [([], [x]) for x in labels] + [([(99, day(90))], [(98, day(90))]), ([(99, day(95))], [(98, day(95))])]
    empty = [spark.createDataFrame([], kind) for kind in ("id long, scraped_at timestamp", "review_id long, analyzed_at timestamp")]
    for frame, name in zip(empty, ("r", "l")):
        frame.write.parquet(f"{at}/{name}/b=0")
    seen = []
    for k, (new_reviews, new_labels) in enumerate([([x for b in batches[:5] for x in b[0]], labels), *batches[-2:]], 1):
        spark.createDataFrame(new_reviews, empty[0].schema).write.parquet(f"{at}/r/b={k}")
        spark.createDataFrame(new_labels, empty[1].schema).write.parquet(f"{at}/l/b={k}")
        streams = [spark.readStream.schema(e.schema).parquet(f"{at}/{n}/*") for e, n in zip(empty, ("r", "l"))]
        out = ingest.unlabelled_after(*streams).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r["id"] for r in spark.read.parquet(f"{at}/out").where("id < 90").collect()))
    # 1 and 5 are labelled within two days; 2 too late, 3 before it was scraped, 4 never.
    assert seen[-1] == [2, 3, 4] and 5 not in seen[0]
