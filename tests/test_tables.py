"""Upserts, merges, ingest and streams."""

import json
from datetime import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as x
from tallyloom.operators import audits, dedup, evaluate, upserts
from tallyloom.plans import star
from tallyloom.sources import landing, sinks, versions
from tallyloom.streaming import ingest, windows
from tallyloom.tables import LANDING, Tables


def entry(name, reviews, lat=16.8, lng=100.2, at="2026-01-31T00:00:00", rating="4,5"):
    return {"place_name": name, "search_query": name, "overall_rating": rating, "lat": lat, "lng": lng, "reviews": [{"rating": r, "text": t, "date": d} for r, t, d in reviews], "scraped_at": at}


FIRST = [
    entry("ร้านหนึ่ง", [(5, "A\n4 เดือนที่แล้ว\nดีมากๆ", "4 เดือนที่แล้ว"), (1, "B\n1 ปีที่แล้ว\nแพงไป", "1 ปีที่แล้ว"), (3, "ok", None)]),
    entry("ร้านสอง", [(2, "C\n2 วันที่แล้ว\nห้องน้ำเหม็น", "2 วันที่แล้ว")]),
    entry("นอกเขต", [(5, "D\nwhatever", None)], lat=10.0),
]
SECOND = [
    entry("ร้านหนึ่ง", [(5, "A\n5 เดือนที่แล้ว\nดีมากๆ", "5 เดือนที่แล้ว"), (4, "E\n1 วันที่แล้ว\nใหม่จริง", "1 วันที่แล้ว")], at="2026-02-28T00:00:00", rating=None),
    entry("ร้านสาม", [], at="2026-02-28T00:00:00"),
]


def test_stream_of_landing_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = lambda entries: "\n".join(json.dumps(e, ensure_ascii=False) for e in entries)
    (source / "1.json").write_text(lines(FIRST), encoding="utf-8")
    run = lambda: ingest.ingest(spark, str(source), str(tmp_path / "db"), str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "2.json").write_text(lines(SECOND), encoding="utf-8")
    run()
    places = {r["name"]: r for r in versions.read(spark, str(tmp_path / "db/places")).collect()}
    reviews = versions.read(spark, str(tmp_path / "db/reviews"))
    assert set(places) == {"ร้านหนึ่ง", "ร้านสอง", "ร้านสาม"}
    assert places["ร้านหนึ่ง"]["overall_rating"] == 4.5  # a missing new value keeps the old one
    assert sorted(r["id"] for r in places.values()) == [1, 2, 3]
    assert sorted(r["text_clean"] for r in reviews.collect()) == sorted(["A ดีมากๆ", "B แพงไป", "C ห้องน้ำเหม็น", "E ใหม่จริง"])
    assert reviews.select("id").distinct().count() == 4
    before = versions.versions(spark, str(tmp_path / "db/reviews"))
    ingest.ingest_batch(spark, spark.createDataFrame([], LANDING).unionByName(landing.read(spark, str(source / "2.json"), multi_line=False)), str(tmp_path / "db"))
    assert versions.read(spark, str(tmp_path / "db/reviews")).count() == 4
    assert len(versions.versions(spark, str(tmp_path / "db/reviews"))) == len(before) + 1


def test_master_merge(spark, tmp_path):
    for name, entries in (("a", FIRST), ("b", SECOND)):
        (tmp_path / f"{name}.json").write_text(json.dumps(entries, ensure_ascii=False), encoding="utf-8")
    merged = landing.merge_master(landing.read(spark, str(tmp_path / "a.json")).where("place_name <> 'นอกเขต'"), landing.read(spark, str(tmp_path / "b.json")))
    got = {r["place_name"]: r for r in merged.collect()}
    assert set(got) == {"ร้านหนึ่ง", "ร้านสอง", "ร้านสาม"}
    assert len(got["ร้านหนึ่ง"]["reviews"]) == 4 and got["ร้านหนึ่ง"]["scraped_at"] == datetime(2026, 2, 28)
    landing.write_master(merged, str(tmp_path / "out"))
    assert landing.read(spark, str(tmp_path / "out"), multi_line=False).count() == 3


def test_numbers_go_on(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    ids = upserts.next_ids(rows, spark.createDataFrame([(41,)], "id long"), ["k"]).orderBy("k").collect()
    assert [r["id"] for r in ids] == list(range(42, 1042))


def test_greedy_pairs_like_a_loop(spark):
    import random

    random.seed(3)
    pairs = [(d, 100 + k, round(random.random(), 3), random.randint(0, 5)) for d, k in product(range(12), range(9)) if random.random() < 0.5]
    used, want = set(), set()
    for d in range(12):
        free = [(dist, off, k) for dd, k, dist, off in pairs if dd == d and k not in used]
        if free:
            used.add(min(free)[2])
            want.add((d, min(free)[2]))
    got = dedup.greedy(spark.createDataFrame(pairs, "drop long, keep long, dist double, off int"))
    assert {(r["drop"], r["keep"]) for r in got.collect()} == want
    assert dedup.greedy(spark.createDataFrame([], "drop long, keep long, dist double, off int")).count() == 0


def test_dedup_is_idempotent(spark, small):
    once = dedup.deleted(star.load(spark, small))
    again = dedup.survey(once).first()
    assert again["dup_groups"] == 0 and again["extra_rows"] == 0


def test_hash_check(spark):
    rows = spark.createDataFrame([(1, "A\nวันนี้\nดี"), (2, "B")], "id long, text string").withColumn("text_hash", F.when(F.col("id") == 1, x.review_text_hash(F.col("text"))))
    assert [r["id"] for r in dedup.wrong_hashes(rows).collect()] == [2]


def test_merge_moves_reviews(spark, small):
    t = star.load(spark, small)
    places = [r["place_id"] for r in t.reviews.select("place_id").distinct().orderBy("place_id").limit(2).collect()]
    moves = spark.createDataFrame([(places[1], places[0])], "drop long, keep long")
    after = dedup.merged(t, moves)
    assert after.places.where(F.col("id") == places[1]).count() == 0
    assert after.reviews.where(F.col("place_id") == places[1]).count() == 0
    held = t.reviews.where(F.col("place_id").isin(*places)).select(x.review_text_hash(F.col("text")).alias("h"))
    mine = t.reviews.where(F.col("place_id") == places[0]).count()
    moved = after.reviews.where(F.col("place_id") == places[0])
    assert mine <= moved.count() <= held.count()
    assert moved.select(x.review_text_hash(F.col("text")).alias("h")).distinct().count() == held.distinct().count()


def test_relabel_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "negative", "teacher"), (2, "neutral", None)], "review_id long, sentiment string, claude_sentiment string")
    new = spark.createDataFrame([(1, "positive")], "review_id long, sentiment string")
    got = {r["review_id"]: (r["sentiment"], r["claude_sentiment"]) for r in ingest.relabel(old, new).collect()}
    assert got == {1: ("positive", "teacher"), 2: ("neutral", None)}


def test_labels_fall_back_to_rules(spark, small):
    t = star.load(spark, small)
    model = lambda todo: ingest.rule_labels(todo.where("id % 2 = 0")).withColumn("model_used", F.lit("model"))
    got = ingest.label_new(t.reviews, t.analyzed, model)
    assert got.count() == ingest.unlabelled(t.reviews, t.analyzed).count()
    assert {r["model_used"] for r in got.collect()} == {"model", "rules"}


def test_kappa_is_symmetric(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "c")], "gold string, pred string")
    one = evaluate.agreement(evaluate.confusion(rows)).first()["kappa"]
    two = evaluate.agreement(evaluate.confusion(rows, "pred", "gold")).first()["kappa"]
    assert one == pytest.approx(two)
    assert evaluate.confusion_matrix(rows, ["a", "b", "c"]).count() == 3


def test_split_keeps_every_row(spark):
    rows = spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("label"))
    got = evaluate.split(rows)
    assert got.count() == 200 and got.groupBy("label").agg(F.countDistinct("split").alias("n")).where("n <> 3").count() == 0


def test_csv_and_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, "ก,ข", 16.8, 100.2), (2, None, None, None)], "id int, name string, lat double, lng double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sinks.read_csv(spark, str(tmp_path / "c"), df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).count() == 2
    whole = json.loads(sinks.collection(df, "id", "name").first()["value"])
    assert whole["features"][0]["geometry"]["coordinates"] == [100.2, 16.8] and len(whole["features"]) == 1
    sinks.write_training_set(spark.createDataFrame([(1, "t", "l", "train")], "id long, text string, label string, split string"), str(tmp_path / "t"))
    assert sinks.read_training_set(spark, str(tmp_path / "t")).first()["split"] == "train"


def test_stream_windows_match_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = windows.tumbling(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("weeks")) == key(windows.tumbling(events, "event_type"))


def test_stream_distinct_texts(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    windows.distinct_texts(stream).writeStream.format("memory").queryName("texts").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("texts").count() == docs.select("text").distinct().count()


def test_cells_left_to_search(spark):
    cells = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "lat double, lng double")
    types = spark.createDataFrame([("cafe",), ("museum",)], "place_type string")
    done = spark.createDataFrame([(1.0, 2.0, "cafe")], "lat double, lng double, place_type string")
    assert audits.planned_cells(cells, types, done).count() == 3


def test_subdivided_cells_leave_out_done_ones(spark, small):
    t = star.load(spark, small)
    jobs = audits.subdivide(spark, t)
    done = jobs.limit(3).select(F.col("lat").alias("cell_lat"), F.col("lng").alias("cell_lng"), F.col("radius_m").alias("cell_radius_m"), "place_type", F.lit("OK").alias("status"))
    more = Tables(t.places, t.reviews, t.analyzed, t.candidates, t.cells.unionByName(done.withColumns({"pages": F.lit(1), "results": F.lit(0), "hit_cap": F.lit(False), "type_matched": F.lit(None).cast("int")})))
    assert audits.subdivide(spark, more).count() == jobs.count() - 3


def test_versions_survive_broken_changes(spark, tmp_path):
    folder = str(tmp_path / "t")
    one = spark.range(3).toDF("id")
    assert versions.current(spark, folder) is None and versions.parts(spark, folder) == []
    versions.write(one, folder)
    # A change that broke off: a part that no version names, and a list that was never renamed.
    one.write.parquet(f"{folder}/p-broken")
    (tmp_path / "t" / "next-broken").write_text("p-broken")
    assert sorted(r["id"] for r in versions.read(spark, folder).collect()) == [0, 1, 2]
    versions.append(spark.range(3, 5).toDF("id"), folder)
    assert sorted(r["id"] for r in versions.read(spark, folder).collect()) == [0, 1, 2, 3, 4]
    assert versions.read(spark, folder, 0).count() == 3
    versions.publish(spark, folder, versions.parts(spark, folder, 0))
    assert versions.read(spark, folder).count() == 3 and versions.versions(spark, folder) == [0, 1, 2]
    assert len(list((tmp_path / "t").glob("p-*"))) == 3  # an append wrote its own rows only


def test_splits_and_quotas_by_hand(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") == 1, None).otherwise("hot").alias("label"))
    got = evaluate.split(rows).groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in got} == {("rare", "test"): 30, ("rare", "val"): 30, ("rare", "train"): 140, ("hot", "test"): 269, ("hot", "val"): 269, ("hot", "train"): 1261, (None, "test"): 1}
    assert {r["label"]: r["count"] for r in evaluate.quota_sample(rows, 50).groupBy("label").count().collect()} == {"rare": 50, "hot": 50, None: 1}


def test_quartiles_of_ranges(spark):
    values = [(i * 37) % 1000 for i in range(1000)] + [5] * 200
    got = audits.quartiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    values.sort()
    assert tuple(got) == (values[300], values[600], values[900])


def test_answers_of_a_place_api(spark, tmp_path):
    result = {"place_id": "g1", "name": "n", "lat": 1.0, "lng": 2.0, "types": ["cafe", "food"], "rating": 4.5, "user_ratings_total": 7, "business_status": "CLOSED_TEMPORARILY", "vicinity": "v"}
    lines = [{"cell_lat": 1.0, "cell_lng": 2.0, "cell_radius_m": 500, "place_type": "cafe", "results": [result]}, {"cell_lat": 1.0, "cell_lng": 2.0, "cell_radius_m": 500, "place_type": "museum", "results": [{**result, "place_id": f"m{i}", "business_status": None} for i in range(60)]}]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    rows = landing.search_results(spark, str(tmp_path / "a.json")).collect()
    first = next(r for r in rows if r["google_place_id"] == "g1")
    assert len(rows) == 61 and first["google_types"] == "cafe,food" and first["type_matches"] and not first["hit_cap"] and first["business_status"] == "closed_temporarily"
    assert all(r["hit_cap"] and not r["type_matches"] and r["business_status"] is None for r in rows if r["google_place_id"] != "g1")
