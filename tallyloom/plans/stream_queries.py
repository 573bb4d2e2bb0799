"""Stateful and joined streams over the review star, replayed from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans.registry import over_star
from tallyloom.plans.table_queries import entries
from tallyloom.sources import scratch, versions
from tallyloom.streaming import ingest, queue

CD = "CASE WHEN coalesce({0}, 0) >= 3 THEN 30 WHEN coalesce({0}, 0) = 2 THEN 14 ELSE 7 END"
QUEUE_SQL = f"""
WITH held AS (SELECT place_id, count(*) AS sc FROM reviews GROUP BY 1),
s0 AS (SELECT p.id, p.name, coalesce(h.sc, 0) AS sc, p.scrape_excluded AS out, p.last_review_count AS last, p.consecutive_no_change AS quiet, p.refresh_shortfalls AS missed, CAST(p.scraped_at AS TIMESTAMP) AS scan FROM places p LEFT JOIN held h ON h.place_id = p.id),
s1 AS (SELECT id, name, sc, out, CASE WHEN id % 4 = 0 THEN sc ELSE last END AS last, CASE WHEN id % 4 <> 0 THEN quiet WHEN sc > coalesce(last, 0) THEN 0 ELSE quiet + 1 END AS quiet,
  CASE WHEN id % 4 = 0 THEN 0 ELSE missed END AS missed, CASE WHEN id % 4 = 0 THEN TIMESTAMP '2001-08-02 00:00:00' ELSE scan END AS scan FROM s0),
s2 AS (SELECT id, name, sc, out, CASE WHEN id % 6 = 0 THEN sc ELSE last END AS last, CASE WHEN id % 6 <> 0 THEN quiet WHEN sc > coalesce(last, 0) THEN 0 ELSE quiet + 1 END AS quiet,
  CASE WHEN id % 6 = 0 THEN 0 WHEN id % 3 = 0 THEN coalesce(missed, 0) + 1 ELSE missed END AS missed, CASE WHEN id % 6 = 0 OR (id % 3 = 0 AND coalesce(missed, 0) + 1 >= 3) THEN TIMESTAMP '2001-08-03 00:00:00' ELSE scan END AS scan FROM s1),
t AS (SELECT *, id % 6 = 0 OR (id % 3 = 0 AND missed >= 3) AS anew FROM (SELECT s2.*, s0.scan + to_days({CD.format("s0.quiet")}) AS due0, s1.scan + to_days({CD.format("s1.quiet")}) AS due1, s2.scan + to_days({CD.format("s2.quiet")}) AS due2 FROM s0 JOIN s1 USING (id) JOIN s2 USING (id))),
d AS (SELECT id, due0 AS due FROM t WHERE due0 <= CASE WHEN id % 4 = 0 THEN TIMESTAMP '2001-08-02 00:00:00' WHEN anew THEN TIMESTAMP '2001-08-03 00:00:00' ELSE TIMESTAMP '2001-08-25 00:00:00' END AND NOT out
  UNION ALL SELECT id, due1 FROM t WHERE id % 4 = 0 AND NOT anew AND due1 <= TIMESTAMP '2001-08-25 00:00:00' AND NOT out
  UNION ALL SELECT id, due2 FROM t WHERE anew AND due2 <= TIMESTAMP '2001-08-25 00:00:00' AND NOT out),
o AS (SELECT 'scanned' AS kind, TIMESTAMP '2001-08-02 00:00:00' AS when_, s1.* FROM s1 WHERE id % 4 = 0 UNION ALL SELECT 'scanned', TIMESTAMP '2001-08-03 00:00:00', s2.* FROM s2 WHERE id % 3 = 0
  UNION ALL SELECT 'due', due, s0.* FROM d JOIN s0 USING (id) WHERE due <= TIMESTAMP '2001-08-03 00:00:00' UNION ALL SELECT 'due', due, s2.* FROM d JOIN s2 USING (id) WHERE due > TIMESTAMP '2001-08-03 00:00:00')
SELECT name, kind, CAST(when_ AS VARCHAR) AS "at", CAST(last AS BIGINT) AS last_review_count, CAST(quiet AS INT) AS consecutive_no_change, CAST(missed AS INT) AS refresh_shortfalls, coalesce(missed, 0) >= 3 AS given_up, CAST({CD.format("quiet")} AS INT) AS cooldown_days FROM o
"""


@over_star("t05_scan_queue_stream", QUEUE_SQL)
def _(t):
    """Three runs from one checkpoint: scans that are all served, a day later some that are missed, and a scan that only moves time on."""
    spark = t.places.sparkSession
    at = scratch.folder(spark, "queue")
    held = t.reviews.groupBy(F.col("place_id").alias("id")).agg(F.count(F.lit(1)).alias("reviews"))
    rows = t.places.join(held, "id", "left").select("id", "name", F.coalesce("reviews", F.lit(0)).alias("reviews"))
    scan = lambda day, outcome: (F.lit(day).cast("timestamp").alias("at"), outcome.alias("outcome"))
    served = rows.where("id % 4 = 0").select("name", *scan("2001-08-02", F.lit("served")), "reviews")
    mixed = rows.where("id % 3 = 0").select("name", *scan("2001-08-03", F.when(F.col("id") % 6 == 0, "served").otherwise("missed")), "reviews")
    clock = spark.range(1).select(F.lit("no place").alias("name"), *scan("2001-08-25", F.lit("missed")), F.lit(0).cast("long").alias("reviews"))
    begin = scratch.cut(t.places)
    for number, scans in enumerate((served, mixed, clock)):
        scans.write.parquet(f"{at}/in/batch={number}")
        stream = spark.readStream.schema(queue.SCANS).parquet(f"{at}/in/*")
        queue.run(stream, f"{at}/out", f"{at}/checkpoint", begin)
    return spark.read.schema(queue.OUT).parquet(f"{at}/out").where("name != 'no place'").select("name", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "last_review_count", "consecutive_no_change", "refresh_shortfalls", "given_up", "cooldown_days")


@over_star(
    "s02_quarantine_stream",
    """WITH l AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'json' WHEN id % 11 = 0 THEN 'object' WHEN id % 13 = 0 THEN 'name' WHEN id % 17 = 0 THEN 'reviews' WHEN id % 19 = 0 THEN 'number' ELSE 'sound' END AS reason FROM places)
SELECT reason, count(*) AS lines, CAST(CASE WHEN reason = 'sound' THEN count(*) END AS BIGINT) AS places FROM l GROUP BY 1""",
)
def _(t):
    """Landing files of which some lines broke off or hold something else, in two runs: sound ones reach the tables, the others the quarantine."""
    spark = t.places.sparkSession
    at = scratch.folder(spark, "quarantine")
    held = entries(t, t.reviews).join(t.places.select("id", F.col("name").alias("place_name")), "place_name")
    line = F.to_json(F.struct(*(c for c in held.columns if c != "id")))
    broken = (
        F.when(F.col("id") % 7 == 0, F.substring(line, 1, 60))
        .when(F.col("id") % 11 == 0, F.lit("[1, 2]"))
        .when(F.col("id") % 13 == 0, F.replace(line, F.lit('"place_name"'), F.lit('"title"')))
        .when(F.col("id") % 17 == 0, F.lit('{"place_name": "some place", "reviews": "none yet"}'))
        .when(F.col("id") % 19 == 0, F.lit('{"place_name": "some place", "lat": "north", "lng": 100.2}'))
    )
    lines = held.select("id", F.coalesce(broken, line).alias("value"))
    for number, part in enumerate((lines.where("id % 2 = 0"), lines.where("id % 2 = 1"))):
        part.select("value").write.text(f"{at}/in/batch={number}")
        ingest.ingest_checked(spark, f"{at}/in/*", f"{at}/db", f"{at}/checkpoint").awaitTermination()
    bad = versions.read(spark, f"{at}/db/quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("lines")).withColumn("places", F.lit(None).cast("long"))
    good = versions.read(spark, f"{at}/db/places").agg(F.count(F.lit(1)).alias("places")).select(F.lit("sound").alias("reason"), F.col("places").alias("lines"), "places")
    return bad.unionByName(good)


@over_star("j05_unlabelled_stream", "SELECT r.id, r.place_id FROM reviews r LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE ar.id IS NULL OR ar.id % 50 = 0")
def _(t):
    """Reviews and labels as two streams; some labels come too late.  A last row in each moves time past all others."""
    spark = t.places.sparkSession
    at = scratch.folder(spark, "unlabelled")
    reviews = t.reviews.select("id", "place_id", F.col("scraped_at").cast("timestamp").alias("scraped_at"))
    delay = F.when(F.col("review_id") % 50 == 0, F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 1 DAY"))
    labels = t.analyzed.select("review_id").join(reviews.select(F.col("id").alias("review_id"), "scraped_at"), "review_id").select("review_id", (F.col("scraped_at") + delay).alias("analyzed_at"))
    clock = F.lit("2030-01-01").cast("timestamp")
    kinds = "id long, place_id long, scraped_at timestamp", "review_id long, analyzed_at timestamp"
    last = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("place_id"), clock.alias("scraped_at")), spark.range(1).select(F.lit(-2).cast("long").alias("review_id"), clock.alias("analyzed_at"))
    for k, (first, end) in enumerate(zip((reviews, labels), last)):
        first.write.parquet(f"{at}/in{k}/b=0")
    for run in range(2):
        if run:
            for k, end in enumerate(last):
                end.write.parquet(f"{at}/in{k}/b=1")
        streams = [spark.readStream.schema(kind).parquet(f"{at}/in{k}/*") for k, kind in enumerate(kinds)]
        out = ingest.unlabelled_after(*streams).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kinds[0]).parquet(f"{at}/out").where("id >= 0").select("id", "place_id")
