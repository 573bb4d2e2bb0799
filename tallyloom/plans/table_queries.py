"""Files in and out, ingest, merges and small operators over the review star."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions import dates, filters as f, geo, measures as m, text as x
from tallyloom.operators import audits, coverage, dedup, evaluate, places as p, snapshots, upserts
from tallyloom.plans import star
from tallyloom.plans.audit_queries import COUNTED
from tallyloom.plans.function_queries import BODY
from tallyloom.plans.insight_queries import haversine_sql
from tallyloom.plans.registry import over_star
from tallyloom.sources import landing, scratch, sinks, versions
from tallyloom.streaming import ingest
from tallyloom.tables import LANDING, Tables

HASH = f"md5(CASE WHEN id % 5 = 0 THEN text ELSE {BODY} END)"


def entries(t: Tables, reviews: DataFrame) -> DataFrame:
    """The star as landing entries: a place with its reviews, at most what a place serves."""
    held = reviews.groupBy(F.col("place_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "rating", "text", "review_date"))).alias("own"))
    rows = t.places.join(held, "id", "left")
    own = F.transform(F.coalesce("own", F.array()), lambda r: F.struct(r["rating"].alias("rating"), r["text"].alias("text"), r["review_date"].alias("date")))
    values = {"place_name": F.col("name"), "search_query": F.col("search_query"), "overall_rating": F.col("overall_rating").cast("string"), "google_category": F.col("google_category"), "business_status": F.col("business_status"), "lat": F.col("lat"), "lng": F.col("lng"), "reviews": own, "scraped_at": F.coalesce("scraped_at", F.lit(star.AS_OF)).cast("timestamp")}
    return rows.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LANDING.fields))


HELD_HASHES = f"(SELECT place_id, count(DISTINCT {HASH}) AS n FROM reviews GROUP BY 1)"


@over_star("s02_landing_reviews", f"SELECT p.name AS place_name, r.rating, {HASH.replace('id %', 'r.id %').replace('CAST(id', 'CAST(r.id')} AS text_hash FROM reviews r JOIN places p ON p.id = r.place_id")
def _(t):
    spark = t.places.sparkSession
    path = scratch.folder(spark, "landing")
    entries(t, t.reviews).write.json(path)
    return landing.reviews(landing.read(spark, path, multi_line=False)).select("place_name", "rating", "text_hash")


@over_star(
    "s03_master_merge",
    f"SELECT p.name AS place_name, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS INT) AS reviews, p.lat FROM places p LEFT JOIN (SELECT place_id, count(*) AS n FROM reviews WHERE id % 2 = 0 GROUP BY 1) a ON a.place_id = p.id LEFT JOIN (SELECT place_id, count(DISTINCT {HASH}) AS n FROM reviews r WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT place_id AS pid, {HASH} AS h FROM reviews WHERE id % 2 = 0) o WHERE o.pid = r.place_id AND o.h = {HASH}) GROUP BY 1) b ON b.place_id = p.id",
)
def _(t):
    merged = landing.merge_master(entries(t, t.reviews.where("id % 2 = 0")), entries(t, t.reviews.where("id % 2 = 1")))
    return merged.select("place_name", F.size(F.coalesce("reviews", F.array())).alias("reviews"), "lat")


@over_star("t02_ingest_stream", f"SELECT p.name AS place_name, h.n AS reviews, h.n AS ids FROM places p JOIN {HELD_HASHES} h ON h.place_id = p.id")
def _(t):
    """Two runs over landing files: the second brings some known reviews and some new ones."""
    spark = t.places.sparkSession
    at = scratch.folder(spark, "ingest")
    for number, reviews in enumerate((t.reviews.where("id % 2 = 0"), t.reviews)):
        entries(t, reviews).write.json(f"{at}/in/batch={number}")
        ingest.ingest(spark, f"{at}/in/*", f"{at}/db", f"{at}/checkpoint").awaitTermination()
    held = versions.read(spark, f"{at}/db/reviews").groupBy("place_id").agg(F.count(F.lit(1)).alias("reviews"), F.count_distinct("id").alias("ids"))
    names = versions.read(spark, f"{at}/db/places").select(F.col("id").alias("place_id"), F.col("name").alias("place_name"))
    return names.join(held, "place_id").select("place_name", "reviews", "ids")


@over_star("s10_cell_log", "SELECT cell_lat, cell_lng, place_type, max(results) AS results FROM discover_cells GROUP BY 1, 2, 3")
def _(t):
    return upserts.last_write(t.cells.select("cell_lat", "cell_lng", "place_type", "results"), ["cell_lat", "cell_lng", "place_type"], "results")


@over_star("s13_csv_round_trip", "SELECT id, name, nullif(google_category, '') AS google_category, overall_rating FROM places")
def _(t):
    spark = t.places.sparkSession
    path = scratch.folder(spark, "csv")
    sinks.write_csv(t.places.select("id", "name", "google_category", "overall_rating"), path, mark=True)
    rows = sinks.read_csv(spark, path)  # the names come from the header, less its mark
    return rows.select(F.col("id").cast("long").alias("id"), "name", "google_category", F.col("overall_rating").cast("double").alias("overall_rating"))


@over_star("s15_training_set", "SELECT r.id, r.text_clean AS text, ar.sentiment AS label FROM reviews r JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE ar.model_used = 'claude-haiku-4-5-full' AND length(r.text_clean) >= 10 AND ar.sentiment IS NOT NULL")
def _(t):
    spark = t.places.sparkSession
    path = scratch.folder(spark, "training")
    sinks.write_training_set(evaluate.split(evaluate.training_rows(t, "sentiment")), path)
    return sinks.read_training_set(spark, path).select("id", "text", "label")


@over_star("s17_geojson", "SELECT 'Feature' AS type, id, lng, lat FROM places WHERE lat IS NOT NULL")
def _(t):
    spark = t.places.sparkSession
    path = scratch.folder(spark, "geojson")
    sinks.write_geojson(t.places, path, "id")
    rows = spark.read.schema("type string, geometry struct<type:string,coordinates:array<double>>, properties struct<id:long>").json(path)
    return rows.select("type", "properties.id", F.get("geometry.coordinates", 0).alias("lng"), F.get("geometry.coordinates", 1).alias("lat"))


@over_star("s22_planned_cells", "SELECT DISTINCT c.cell_lat AS lat, c.cell_lng AS lng, y.place_type FROM discover_cells c, (SELECT DISTINCT place_type FROM discover_cells) y WHERE NOT EXISTS (SELECT 1 FROM discover_cells d WHERE d.cell_lat = c.cell_lat AND d.cell_lng = c.cell_lng AND d.place_type = y.place_type AND d.status = 'OK')")
def _(t):
    cells = t.cells.select(F.col("cell_lat").alias("lat"), F.col("cell_lng").alias("lng"))
    done = t.cells.where("status = 'OK'").select(F.col("cell_lat").alias("lat"), F.col("cell_lng").alias("lng"), "place_type")
    return audits.planned_cells(cells.distinct(), t.cells.select("place_type").distinct(), done.distinct())


@over_star("q26_wrong_hashes", f"SELECT id, {HASH} AS expected FROM reviews WHERE id % 10 = 3")
def _(t):
    stored = t.reviews.withColumn("text_hash", F.when(F.col("id") % 10 == 3, F.when(F.col("id") % 20 == 3, "wrong")).otherwise(x.review_text_hash(F.col("text"))))
    return dedup.wrong_hashes(stored).select("id", "expected")


MOVED = f"SELECT *, CASE WHEN place_id IN (3, 5, 8) THEN 1 ELSE place_id END AS target, row_number() OVER (PARTITION BY CASE WHEN place_id IN (3, 5, 8) THEN 1 ELSE place_id END, {HASH} ORDER BY place_id IN (3, 5, 8), id) AS n FROM reviews"


@over_star("q28_merged_places", f"SELECT target AS place_id, count(*) AS n FROM ({MOVED}) WHERE NOT (place_id IN (3, 5, 8) AND n > 1) GROUP BY 1")
def _(t):
    moves = t.places.where("id IN (3, 5, 8)").select(F.col("id").alias("drop"), F.lit(1).cast("long").alias("keep"))
    return dedup.merged(t, moves).reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))


@over_star("j08_common_hashes", f"SELECT DISTINCT {HASH} AS h FROM reviews WHERE place_id = 1 AND {HASH} IN (SELECT {HASH} FROM reviews WHERE place_id = 2)")
def _(t):
    return dedup.common_hashes(t, 1, 2)


@over_star("j09_distance_of_two", f"SELECT round({haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng', 6371000.0)}, 3) AS metres FROM places a, places b WHERE a.id = 1 AND b.id = 2")
def _(t):
    return dedup.distance_between(t, 1, 2).select(F.round("metres", 3).alias("metres"))


@over_star("d19_ranked_by", f"SELECT id, gap FROM {COUNTED} WHERE gap > 0 ORDER BY gap DESC, id LIMIT 20")
def _(t):
    return p.ranked_by(coverage.counted(t).select("id", "gap"), F.col("gap"), 20)


@over_star("l07_random_sample_size", "SELECT least(count(*), 50) AS n, least(count(*), 50) AS distinct_ids, true AS known FROM reviews")
def _(t):
    drawn = evaluate.random_sample(t.reviews.select("id"), 50)
    known = drawn.join(t.reviews.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("k"))
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct_ids")).crossJoin(known).select("n", "distinct_ids", (F.col("k") == F.col("n")).alias("known"))


@over_star("x11_cell_key", "SELECT printf('%.5f,%.5f,%d', cell_lat, cell_lng, cell_radius_m) AS cell_key, count(*) AS n FROM discover_cells GROUP BY 1")
def _(t):
    return t.cells.groupBy(geo.cell_key(F.col("cell_lat"), F.col("cell_lng"), F.col("cell_radius_m")).alias("cell_key")).agg(F.count(F.lit(1)).alias("n"))


@over_star("x23_delta_cells", "SELECT id, CASE WHEN google_reviews_total IS NULL THEN '—' ELSE concat(CAST(google_reviews_total AS VARCHAR), ' (', CASE WHEN sc = google_reviews_total THEN '–' WHEN sc > google_reviews_total THEN '+' || CAST(sc - google_reviews_total AS VARCHAR) ELSE CAST(sc - google_reviews_total AS VARCHAR) END, ')') END AS cell FROM (SELECT id, sc, CASE WHEN google_reviews_total > 900 THEN 900 ELSE google_reviews_total END AS google_reviews_total FROM " + COUNTED + ")")
def _(t):
    rows = coverage.counted(t).select("id", "sc", F.when(F.col("google_reviews_total").isNotNull(), F.least("google_reviews_total", F.lit(900))).alias("total"))
    return rows.select("id", m.delta_cell(F.col("sc"), F.col("total")).alias("cell"))


@over_star("x32_type_matches", "SELECT matched_place_id, CAST(count(*) FILTER (list_contains(string_split(google_types, ','), source_type)) AS INT) AS n FROM place_candidates WHERE matched_place_id IS NOT NULL GROUP BY 1")
def _(t):
    held = t.candidates.where("matched_place_id IS NOT NULL").groupBy("matched_place_id", "source_type").agg(F.collect_list("google_types").alias("types"))
    return held.groupBy("matched_place_id").agg(F.sum(x.count_type_matches(F.col("types"), F.col("source_type"))).cast("int").alias("n"))


@over_star("x34_enough", f"SELECT id, sc > 0 AND (coalesce(ceil, 0) = 0 OR sc >= 0.5 * ceil) AS enough FROM {COUNTED}")
def _(t):
    return coverage.counted(t).select("id", coverage.enough(F.col("sc"), F.coalesce("ceil", F.lit(0))).alias("enough"))


@over_star("e08_gain", "SELECT zone, (b - a) / greatest(a, 0.001) AS gain FROM (SELECT coalesce(zone, 'other') AS zone, avg(CASE WHEN id % 2 = 0 THEN overall_rating ELSE 0 END) AS a, avg(coalesce(overall_rating, 0)) AS b FROM places GROUP BY 1)")
def _(t):
    rows = t.places.groupBy(F.coalesce("zone", F.lit("other")).alias("zone")).agg(F.avg(F.when(F.col("id") % 2 == 0, F.col("overall_rating")).otherwise(0.0)).alias("a"), F.avg(F.coalesce("overall_rating", F.lit(0.0))).alias("b"))
    return rows.select("zone", evaluate.gain(F.col("a"), F.col("b")).alias("gain"))


@over_star("f19_date_presets", "SELECT count(*) FILTER (d BETWEEN DATE '2001-07-04' AND DATE '2001-08-02') AS last_30_days, count(*) FILTER (d BETWEEN DATE '2001-05-02' AND DATE '2001-08-02') AS last_3_months, count(*) FILTER (year(d) = 1997) AS year_1997, count(*) FILTER (year(d) = 1996 AND month(d) = 2) AS february_1996 FROM (SELECT review_date_approx AS d FROM reviews)")
def _(t):
    def within(span):
        return m.n_if(F.coalesce(F.col("review_date_approx").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")), F.lit(False)))

    spans = {"last_30_days": dates.last_days(star.AS_OF, 30), "last_3_months": dates.last_months(star.AS_OF, 3), "year_1997": dates.whole_year(1997), "february_1996": dates.whole_month(1996, 2)}
    return t.reviews.agg(*(within(s).alias(name) for name, s in spans.items()))


#: Thai words with vowels that are written before their consonants, marks and rare letters.
WORDS = ("เกาะ", "กาแฟ", "แมว", "ขา", "โรงแรม", "ไร่", "ใจดี", "ร้าน", "เขา", "ห้อง", "ฤดู")
THAI_NAME = "CASE CAST({0} % 11 AS INT) " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"
THAI_NAMES = f"concat({THAI_NAME.format('id')}, ' ', {THAI_NAME.format('id * 7')}, CASE WHEN id % 3 = 0 THEN ' Cafe' WHEN id % 3 = 1 THEN ' CAFE' ELSE ' ก' END)"


@over_star("l10_thai_order", f"SELECT * FROM (SELECT id, name, CAST(row_number() OVER (ORDER BY name COLLATE th, id) AS INT) AS place FROM (SELECT id, {THAI_NAMES} AS name FROM places)) WHERE place BETWEEN 101 AND 600")
def _(t):
    """The second page of 500 places in the order of Thai dictionaries."""
    named = Tables(t.places.withColumn("name", F.expr(THAI_NAMES)), t.reviews, t.analyzed)
    page = p.list_places(named, limit=500, offset=100, collation="th").select("id", "name")
    return page.select("id", "name", (F.lit(100) + F.row_number().over(Window.orderBy(F.collate("name", "th"), "id"))).cast("int").alias("place"))  # 500 rows


@over_star("l10_same_names", f"SELECT min(name) AS name, count(*) AS n_places, count(DISTINCT name) AS n_spellings FROM (SELECT {THAI_NAMES} AS name FROM places) GROUP BY lower(name) HAVING count(*) > 1")
def _(t):
    return p.same_names(Tables(t.places.withColumn("name", F.expr(THAI_NAMES)), t.reviews, t.analyzed))


@over_star("q36_nearest_five", f"SELECT id, name, zone, round({haversine_sql('lat', 'lng', '16.7442', '100.1956', 6371.0)}, 3) AS distance_nu_km, round({haversine_sql('lat', 'lng', '16.8299369', '100.2075576', 6371.0)}, 3) AS distance_psru_km FROM places WHERE lat IS NOT NULL ORDER BY 4, id LIMIT 5")
def _(t):
    return p.nearest_to_campus(t)


@over_star("s02_count_differences", f"SELECT p.name AS place_name, CAST(h.n AS BIGINT) AS landed, c.n AS stored, h.n - c.n AS difference FROM places p JOIN {HELD_HASHES} h ON h.place_id = p.id JOIN (SELECT place_id, count(*) AS n FROM reviews GROUP BY 1) c ON c.place_id = p.id WHERE h.n <> c.n")
def _(t):
    """What landing files would hold against tables that took every copy in."""
    return landing.count_differences(entries(t, t.reviews), t.places, t.reviews)


CELL = "CAST(substring(google_place_id, 3) AS BIGINT)"


@over_star(
    "s11_search_results",
    f"SELECT google_place_id, name, lat, lng, google_types, google_reviews_total, source_type, list_contains(string_split(google_types, ','), source_type) AS type_matches, count(*) OVER (PARTITION BY {CELL} // CASE WHEN {CELL} % 3000 < 1500 THEN 500 ELSE 100 END, {CELL} % 3000 < 1500, source_type) >= 60 AS hit_cap FROM place_candidates",
)
def _(t):
    """Saved answers of a place API, some at their cap, written and read again."""
    spark = t.places.sparkSession
    path = scratch.folder(spark, "answers")
    near = F.expr(f"{CELL} % 3000 < 1500")
    found = F.struct(F.col("google_place_id").alias("place_id"), "name", "lat", "lng", F.split("google_types", ",").alias("types"), F.col("google_reviews_total").alias("user_ratings_total"))
    rows = t.candidates.withColumns({"near": near, "cell": F.expr(f"{CELL} div CASE WHEN {CELL} % 3000 < 1500 THEN 500 ELSE 100 END")})
    # A cell has at most 500 ids, so a line is short.
    rows.groupBy("near", "cell", F.col("source_type").alias("place_type")).agg(F.collect_list(found).alias("results")).select(F.col("cell").cast("double").alias("cell_lat"), F.col("cell").cast("double").alias("cell_lng"), F.lit(500).alias("cell_radius_m"), "place_type", "results").write.json(path)
    return landing.search_results(spark, path).select("google_place_id", "name", "lat", "lng", "google_types", "google_reviews_total", "source_type", "type_matches", "hit_cap")


@over_star(
    "s19_job_log",
    """SELECT id, 'refresh' AS job_type, CASE id WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'running' END AS status, CAST(scraped_at AS DATE) AS started_at, CASE WHEN id IN (1, 2) THEN DATE '2001-08-03' END AS finished_at,
  CASE WHEN id = 1 THEN (SELECT count(*) FROM places) END AS places_count, CASE WHEN id = 1 THEN (SELECT count(*) FROM reviews) END AS reviews_count, CASE WHEN id = 2 THEN 'blocked' END AS error FROM places WHERE scraped_at IS NOT NULL""",
)
def _(t):
    """A log in which every scanned place is a job that has begun; one ends with the tables' counts, one fails."""
    columns = {"job_type": F.lit("refresh"), "status": F.lit("running"), "started_at": F.col("scraped_at"), "finished_at": F.lit(None).cast("date"), "places_count": F.lit(None).cast("long"), "reviews_count": F.lit(None).cast("long"), "error": F.lit(None).cast("string")}
    log = t.places.where("scraped_at IS NOT NULL").select("id", *(c.alias(n) for n, c in columns.items()))
    end = star.AS_OF.replace(day=3)
    log = p.job_ended(log, 1, end, t.places.count(), t.reviews.count())
    return p.jobs(p.job_ended(log, 2, end, error="blocked"), limit=2_000_000_000)


MONTHS = "SELECT last_day(m) AS as_of FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(review_date_approx)) FROM reviews), (SELECT max(review_date_approx) FROM reviews r JOIN analyzed_reviews ar ON ar.review_id = r.id JOIN places p ON p.id = r.place_id WHERE ar.pain_point_category IS NOT NULL AND coalesce(r.text_clean, '') <> ''), INTERVAL 1 MONTH)) AS m)"


@over_star(
    "q24_monthly_categories",
    f"""WITH months AS ({MONTHS}) SELECT as_of, CASE WHEN grouping(zone) = 1 THEN NULL ELSE zone END AS zone, category, count(*) FILTER (s = 'negative') AS complaint_count, count(*) FILTER (s = 'positive') AS praise_count,
  count(*) FILTER (s = 'negative' AND severity = 'high') AS high_count, count(*) FILTER (s = 'negative' AND severity = 'medium') AS medium_count, count(*) FILTER (s = 'negative' AND severity = 'low') AS low_count
  FROM (SELECT coalesce(p.zone, 'other') AS zone, ar.pain_point_category AS category, ar.sentiment AS s, ar.severity, d.as_of FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id JOIN places p ON p.id = r.place_id JOIN months d ON r.review_date_approx <= d.as_of
  WHERE ar.pain_point_category IS NOT NULL AND coalesce(r.text_clean, '') <> '') GROUP BY GROUPING SETS ((category, as_of), (zone, category, as_of))""",
)
def _(t):
    return snapshots.monthly_categories(t)


@over_star("a02_sketched_reviews", "SELECT coalesce(p.zone, 'other') AS zone, count(DISTINCT r.id) AS exact, true AS near FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id JOIN places p ON p.id = r.place_id WHERE r.review_date_approx BETWEEN DATE '1995-03-05' AND DATE '1997-10-20' GROUP BY 1")
def _(t):
    """Distinct reviews of a range of days from daily sketches; near: within three standard errors of the exact number."""
    rows = t.star().select(f.zone_of().alias("zone"), "review_date_approx", "id")
    kept = scratch.cut(snapshots.daily_sketches(rows, "review_date_approx", ["zone"], "id"))
    told = snapshots.distinct_in(kept, ["zone"], date(1995, 3, 5), date(1997, 10, 20))
    exact = rows.where(f.in_period("1995-03-05", "1997-10-20")).groupBy("zone").agg(F.count_distinct("id").alias("exact"))
    return exact.join(told, "zone").select("zone", "exact", (F.abs(F.col("n") - F.col("exact")) <= 3 * 1.04 / 64 * F.col("exact")).alias("near"))
