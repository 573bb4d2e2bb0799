"""Audits of places, dates and labels; candidates and their promotion; search cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.functions import dates, domain, filters as f, geo, measures as m, text as x
from tallyloom.operators import coverage
from tallyloom.sources.scratch import cut
from tallyloom.tables import Tables

# Place types of the API, names out of scope, and categories by type, in order.
WANTED_TYPES = ("cafe", "restaurant", "bakery", "tourist_attraction", "museum", "park", "university", "place_of_worship")
CHAINS = (
    "starbucks|cafe ?amazon|café ?amazon|อเมซอน|inthanin|อินทนิล|pizza company|sukishi|mcdonald|แมคโดนัลด์|kfc|เคเอฟซี|sizzler|ซิซซ์เล่อร์|swensen|สเวนเซ่น|dairy queen|"
    "7-eleven|เซเว่น|bonchon|ชาบูชิ|yayoi|ยาโยอิ|ฟูจิ|mk restaurant|เอ็มเค|texas chicken|burger king|โออิชิ|oishi|สุกี้ตี๋น้อย|ตี๋น้อย"
)
OUT_OF_SCOPE = (
    "โรงแรม|hotel|resort|รีสอร์ท|hostel|โฮสเทล|เกสท์เฮาส์|guest ?house|เซ็นทรัล|central ?plaza|central ?phitsanulok|โลตัส|lotus|บิ๊กซี|big ?c|makro|แม็คโคร|homepro|โฮมโปร|"
    "โกลบอลเฮ้าส์|global ?house|ไทวัสดุ|dohome|ดูโฮม|index living|อินเด็กซ์"
)
UNSEARCHABLE_TYPES = (
    "place_of_worship", "food", "point_of_interest", "establishment", "health", "finance", "general_contractor", "geocode", "natural_feature",
    "political", "premise", "room", "route", "street_address", "subpremise", "town_square", "intersection", "locality", "post_box", "postal_code",
    "administrative_area_level_1", "administrative_area_level_2", "administrative_area_level_3", "sublocality",
)
LEAST_HONOURED = 0.5
TYPE_CATEGORIES = (
    ("bakery", "ร้านเบเกอรี่"),
    ("cafe", "ร้านกาแฟ"),
    ("restaurant", "ร้านอาหาร"),
    ("museum", "พิพิธภัณฑ์"),
    ("park", "สวนสาธารณะ"),
    ("university", "มหาวิทยาลัย"),
    ("place_of_worship", "ศาสนสถาน"),
    ("tourist_attraction", "สถานที่ท่องเที่ยว"),
    ("campground", "ลานกางเต็นท์"),
    ("lodging", "ที่พัก"),
    ("library", "ห้องสมุด"),
    ("stadium", "สนามกีฬา"),
    ("travel_agency", "บริษัทนำเที่ยว"),
    ("store", "ร้านค้า"),
    ("food", "ร้านอาหาร"),
)
BUTTON_STARTS = ("เพิ่ม", "อ้างสิทธิ์", "แนะนำ", "ยืนยัน", "Add ", "Claim ", "Suggest ")
# End of fixed values.

DRIFT_METRES = 100.0


def with_reference(t: Tables) -> DataFrame:
    """Places with the coordinates of a candidate matched to them, the first by external id."""
    order = Window.partitionBy("matched_place_id").orderBy("google_place_id")
    reference = t.candidates.where("matched_place_id IS NOT NULL AND lat IS NOT NULL").withColumn("n", F.row_number().over(order)).where("n = 1")
    reference = reference.select(F.col("matched_place_id").alias("id"), F.col("lat").alias("ref_lat"), F.col("lng").alias("ref_lng"))
    return t.places.join(reference, "id", "left")


def drift(t: Tables) -> DataFrame:
    """Metres between a place and its reference, both zones, and whether to mend it."""
    rows = with_reference(t).where("lat IS NOT NULL AND ref_lat IS NOT NULL")
    metres = geo.haversine(F.col("lat"), F.col("lng"), F.col("ref_lat"), F.col("ref_lng"), geo.M)
    return rows.select("id", "name", "zone", metres.alias("metres"), geo.assign_zone(F.col("ref_lat"), F.col("ref_lng")).alias("new_zone")).withColumn("mend", F.col("metres") >= DRIFT_METRES)


def drift_bands(t: Tables) -> DataFrame:
    d = F.col("metres")
    band = F.when(d < 50, "0-50 m").when(d < 100, "50-100 m").when(d < 500, "100-500 m").when(d < 2000, "500 m-2 km").when(d < 10000, "2-10 km").otherwise("over 10 km")
    rows = drift(t).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("places"))
    return rows.crossJoin(rows.agg(F.sum("places").alias("whole"))).withColumn("percent", F.col("places") / F.col("whole") * 100).drop("whole")


def zone_moves(t: Tables) -> DataFrame:
    rows = drift(t).where("mend").where(~F.col("new_zone").eqNullSafe(F.col("zone")))
    return rows.groupBy(F.col("zone").alias("old"), F.col("new_zone").alias("new")).agg(F.count(F.lit(1)).alias("n"))


def _like_any(column: Column, parts) -> Column:
    return f.matches_any(column, parts)


def worth_promoting(least_reviews=50) -> Column:
    """New candidates with enough reviews, of a wanted type, that are no chain, hotel or mall.

    Types are looked for anywhere in the joined list, so ``park`` finds ``amusement_park``.
    """
    types = F.col("google_types")
    pure = _like_any(types, ("lodging", "shopping_mall", "supermarket", "department_store")) & ~_like_any(types, ("restaurant", "cafe"))
    named = F.col("name").rlike(f"(?iu){CHAINS}") | F.col("name").rlike(f"(?iu){OUT_OF_SCOPE}")
    return (F.col("decision") == "new") & (F.col("google_reviews_total") >= least_reviews) & _like_any(types, WANTED_TYPES) & ~(named | pure)


def near_places(t: Tables, least_reviews=50, metres=40.0) -> DataFrame:
    """The nearest place of each candidate within reach, unless it has another external id."""
    rows = t.candidates.where(worth_promoting(least_reviews)).select("google_place_id", "lat", "lng")
    pairs = geo.grid_pairs(rows, t.places.select("id", "google_place_id", "lat", "lng"), metres)
    same = F.col("r_google_place_id").isNull() | (F.col("r_google_place_id") == F.col("l_google_place_id"))
    nearest = F.row_number().over(Window.partitionBy("l_google_place_id").orderBy("dist", "r_id"))
    return pairs.where(same).withColumn("n", nearest).where("n = 1").select(F.col("l_google_place_id").alias("google_place_id"), F.col("r_id").alias("near_id"), F.col("r_google_place_id").alias("near_gpid"), "dist")


def promotion_plan(t: Tables, least_reviews=50) -> DataFrame:
    """What to do with each candidate: outside, fill, clash, same or insert, with its zone and campus distances."""
    rows = t.candidates.where(worth_promoting(least_reviews)).join(near_places(t, least_reviews), "google_place_id", "left")
    names = t.places.select("name", F.col("id").alias("name_id"), F.col("google_place_id").alias("name_gpid"))
    rows = rows.join(names, "name", "left")
    by_name = F.when(F.col("name_id").isNull(), None).when(F.col("name_gpid") == F.col("google_place_id"), "same").when(F.col("name_gpid").isNull(), "fill").otherwise("clash")
    action = F.when(~geo.in_province(F.col("lat"), F.col("lng")), "outside").when(F.col("near_id").isNotNull() & F.col("near_gpid").isNull(), "fill").otherwise(F.coalesce(by_name, F.lit("insert")))
    nu, psru = geo.campus_distances(F.col("lat"), F.col("lng"))
    target = F.when(F.col("near_id").isNotNull() & F.col("near_gpid").isNull(), F.col("near_id")).otherwise(F.col("name_id"))
    return rows.select("google_place_id", "name", "google_reviews_total", action.alias("action"), target.alias("place_id"), geo.assign_zone(F.col("lat"), F.col("lng")).alias("zone"), nu.alias("distance_nu_km"), psru.alias("distance_psru_km"))


def promotion_size(t: Tables, least_reviews=50) -> DataFrame:
    """One row: candidates, what a refresh and a deep scan would bring, without details, at the ceiling."""
    g = F.col("google_reviews_total")
    return t.candidates.where(worth_promoting(least_reviews)).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.least(g, F.lit(domain.REFRESH_CAP))), F.lit(0)).cast("long").alias("ref"),
        F.coalesce(F.sum(F.least(g, F.lit(domain.SERVE_CEILING))), F.lit(0)).cast("long").alias("deep"),
        m.n_if(F.col("formatted_address").isNull() & F.col("opening_hours").isNull()).alias("need_det"),
        m.n_if(g >= domain.SERVE_CEILING).alias("cap"),
    )


def rings(t: Tables) -> DataFrame:
    """Candidates by nearest zone and kilometre ring (0 to 4; 5 is beyond)."""
    ring = F.width_bucket(F.col("dist_km"), F.lit(0.0), F.lit(4.0), F.lit(4)).cast("int")
    return t.candidates.where("dist_km IS NOT NULL").groupBy(F.col("nearest_zone").alias("zone"), ring.alias("ring")).agg(
        m.n_if(F.col("decision") == "new").alias("new"), m.n_if(F.col("decision") == "existing").alias("old"), F.coalesce(F.sum(F.when(F.col("decision") == "new", F.col("google_reviews_total"))), F.lit(0)).alias("reviews")
    )


def type_honour(t: Tables) -> DataFrame:
    """By searched type: how many results had that type, of those that were looked at, and a verdict."""
    checked = F.when(F.col("type_matched").isNotNull(), F.col("results"))
    rows = t.cells.groupBy("place_type").agg(
        F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("results"), F.lit(0)).alias("results"), F.coalesce(F.sum(checked), F.lit(0)).alias("checked"), F.coalesce(F.sum("type_matched"), F.lit(0)).alias("matched"), m.n_if(F.col("type_matched").isNull()).alias("unchecked"), m.n_if(F.col("hit_cap")).alias("capped")
    )
    ratio = m.rate(F.col("matched"), F.nullif("checked", F.lit(0)))
    verdict = F.when(F.col("place_type").isin(*UNSEARCHABLE_TYPES), "unsearchable").when(F.col("checked") == 0, "unknown").when(ratio >= 0.9, "trusted").when(ratio >= LEAST_HONOURED, "check each").otherwise("ignored")
    return rows.withColumns({"ratio": ratio, "verdict": verdict})


def subdivide(spark: SparkSession, t: Tables) -> DataFrame:
    """Cells of half the radius that cover capped ones, one lattice for each type and radius, without those done.

    All of it is one plan over ``t.cells``; ``spark`` is the session of those tables.
    """
    ignored = F.coalesce(m.rate(F.col("type_matched"), F.nullif("results", F.lit(0))) < LEAST_HONOURED, F.lit(False)) & F.col("type_matched").isNotNull()
    capped = t.cells.where(F.col("hit_cap") & (F.col("cell_radius_m") > 100) & ~F.col("place_type").isin(*UNSEARCHABLE_TYPES) & ~ignored)
    circles = capped.select("place_type", "cell_radius_m", F.col("cell_lat").alias("lat"), F.col("cell_lng").alias("lng"), (F.col("cell_radius_m") / 1000).alias("area_km"), (F.col("cell_radius_m") / 2000).alias("cell_km"))
    cells = geo.lattice(circles, ["place_type", "cell_radius_m"])
    jobs = cells.select("lat", "lng", "place_type", F.floor(F.col("cell_radius_m") / 2).cast("int").alias("radius_m"))
    done = t.cells.where(F.col("status").isin("OK", "ZERO_RESULTS")).select(F.round("cell_lat", 6).alias("lat"), F.round("cell_lng", 6).alias("lng"), "place_type", F.col("cell_radius_m").cast("int").alias("radius_m"))
    return jobs.join(done, ["lat", "lng", "place_type", "radius_m"], "left_anti").dropDuplicates(["lat", "lng", "place_type", "radius_m"])


def planned_cells(cells: DataFrame, types: DataFrame, done: DataFrame) -> DataFrame:
    """Cell and type pairs that have not been searched; types are a short fixed list."""
    return cells.crossJoin(types).join(done, ["lat", "lng", "place_type"], "left_anti")


def exclusion_candidates(t: Tables) -> DataFrame:
    """Pure lodging and administrative areas that are still in scope."""
    types = F.col("google_types")
    lodging = types.contains("lodging") & ~_like_any(types, ("restaurant", "cafe"))
    area = (types.contains(",political") | types.startswith("political") | _like_any(types, ("locality", "administrative_area_level"))) & ~_like_any(types, ("restaurant", "cafe", "lodging", "tourist_attraction"))
    reason = F.when(lodging, "lodging").when(area, "area")
    return coverage.counted(t).where(~F.col("scrape_excluded")).withColumn("reason", reason).where("reason IS NOT NULL").select("id", "name", "zone", "google_reviews_total", "sc", "reason")


def category_of_types(types: Column) -> Column:
    parts = F.transform(F.split(types, ","), lambda p: F.trim(p))
    return F.coalesce(*(F.when(F.array_contains(parts, kind), thai) for kind, thai in TYPE_CATEGORIES))


def dirty_categories(t: Tables) -> DataFrame:
    """Places whose category is missing or a button's text, with one by their types (null if none)."""
    c = F.col("google_category")
    dirty = c.isNull() | (c == "") | (f.starts_with_any(c, BUTTON_STARTS) & x.is_ui_button(c))
    return t.places.where(dirty).select("id", "name", "google_category", category_of_types(F.col("google_types")).alias("new_category"))


def missing_dates(t: Tables) -> DataFrame:
    """Reviews without date whose date can be told from a phrase, and where that was."""
    rows = t.reviews.where("review_date_approx IS NULL")
    own, raw = dates.relative_phrase(F.col("review_date")), dates.relative_phrase(F.col("text"))
    rows = rows.select("id", "scraped_at", own.alias("own"), raw.alias("raw")).withColumns({"phrase": F.coalesce("own", "raw"), "source": F.when(F.col("own").isNotNull(), "review_date").otherwise("text")})
    return rows.withColumn("date", dates.relative_date(F.col("phrase"), F.col("scraped_at").cast("date"))).where("date IS NOT NULL").select("id", "date", "phrase", "source")


def impossible_dates(t: Tables, as_of) -> DataFrame:
    """One pass: dates in the future, before 2008, and after the scan."""
    d = F.col("review_date_approx")
    return t.reviews.agg(m.n_if(d > F.lit(as_of)).alias("future"), m.n_if(d < F.lit("2008-01-01").cast("date")).alias("before_2008"), m.n_if(d > F.col("scraped_at").cast("date")).alias("after_scan"))


def completeness(t: Tables) -> DataFrame:
    """Non-null values of each column of places, with the number of places."""
    return t.places.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"has_{c}") for c in ("google_place_id", "google_types", "google_reviews_total", "overall_rating", "lat", "zone", "scraped_at", "deep_scanned_at", "business_status")))


def quartiles(rows: DataFrame, column: str) -> DataFrame:
    """Elements n//4, n//2 and 3n//4 (from 0) of the sorted values, by counting ranks.

    Distinct values are sorted in ranges and counted on from each range's offset, so no
    task sees them all.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    # One row a range.
    sizes = placed.groupBy("part").agg(F.sum("c").alias("size"), F.min("v").alias("least"))
    ahead = sizes.select("part", (F.sum("size").over(Window.orderBy("least")) - F.col("size")).alias("ahead"))
    upto = placed.join(ahead, "part").withColumn("upto", F.col("ahead") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    upto = upto.crossJoin(sizes.agg(F.sum("size").alias("n")))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(F.lit(k) * F.col("n") / 4), F.col("v")))
    return upto.agg(at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"))


def zone_counts(t: Tables) -> DataFrame:
    return t.places.groupBy(f.zone_of().alias("zone")).agg(F.count(F.lit(1)).alias("places"), F.count("lat").alias("with_coordinates"), F.avg("overall_rating").alias("avg_rating")).withColumn("avg_rating", F.round("avg_rating", 2))


def table_counts(t: Tables) -> DataFrame:
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
    return one("places", t.places).unionByName(one("reviews", t.reviews)).unionByName(one("analyzed_reviews", t.analyzed))


def date_span(t: Tables) -> DataFrame:
    return t.reviews.agg(F.min("review_date_approx").alias("first"), F.max("review_date_approx").alias("last"), F.count("review_date_approx").alias("dated"), F.count(F.lit(1)).alias("reviews"), F.round(F.avg(F.length("text_clean")), 2).alias("avg_length"))


def shared_external_ids(t: Tables) -> DataFrame:
    """External ids that several places hold, with their names."""
    rows = t.places.where("google_place_id IS NOT NULL").groupBy("google_place_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), " | ").alias("names"))
    return rows.where("n > 1")


def owners_of(t: Tables, wanted: DataFrame) -> DataFrame:
    """Planned updates (id, google_place_id) whose external id another place has."""
    owner = t.places.select("google_place_id", F.col("id").alias("owner_id"))
    return wanted.join(owner, "google_place_id").where("owner_id != id")


def trailing_known(reviews: DataFrame, known: DataFrame) -> DataFrame:
    """For each place of (place_id, pos, h): how many of its last reviews in a row have a known hash."""
    marked = reviews.join(known.select("h").distinct().withColumn("known", F.lit(True)), "h", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return marked.groupBy("place_id").agg((F.max("pos") - F.coalesce(F.max(F.when(~F.col("known"), F.col("pos"))), F.min("pos") - 1)).alias("trailing_known"))
