"""Coverage, queues, duplicates, geography, candidates and data quality over the review star."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyloom.functions import domain, geo
from tallyloom.operators import audits, coverage, dedup, upserts
from tallyloom.plans import star
from tallyloom.plans.insight_queries import HT, haversine_sql
from tallyloom.plans.registry import over_star

AS_OF = f"DATE '{star.AS_OF.isoformat()}'"
HELD = f"(SELECT r.place_id, count(*) AS sc, count(*) FILTER ({HT}) AS sct FROM reviews r GROUP BY 1)"
COUNTED = f"(SELECT *, ceil - sc AS gap FROM (SELECT p.*, coalesce(h.sc, 0) AS sc, coalesce(h.sct, 0) AS sct, CASE WHEN google_reviews_total IS NOT NULL THEN least(google_reviews_total, 850) END AS ceil FROM places p LEFT JOIN {HELD} h ON h.place_id = p.id))"
INSIDE = "NOT scrape_excluded AND google_reviews_total IS NOT NULL"
LISTED = "id, name, google_reviews_total, sc, ceil, gap"


def _n(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


@over_star(
    "q25_coverage_totals",
    f"""SELECT *, CASE WHEN possible > 0 THEN CAST(held AS DOUBLE) / possible END AS coverage FROM (SELECT count(*) AS places, {_n('scrape_excluded')} AS excluded, {_n('NOT scrape_excluded AND google_reviews_total IS NULL')} AS unmeasurable,
  CAST(coalesce(sum(sc) FILTER ({INSIDE}), 0) AS BIGINT) AS held, CAST(coalesce(sum(ceil) FILTER ({INSIDE}), 0) AS BIGINT) AS possible, {_n(f'{INSIDE} AND gap >= 50')} AS gap_50, {_n(f'{INSIDE} AND deep_scanned_at IS NULL')} AS never_deep,
  {_n(f'{INSIDE} AND scraped_at IS NULL')} AS queued, {_n(f'{INSIDE} AND coalesce(refresh_shortfalls, 0) >= 3')} AS given_up, {_n(f'{INSIDE} AND sc > ceil')} AS over, {_n(f'{INSIDE} AND sc > ceil AND sct > ceil')} AS over_with_text FROM {COUNTED})""",
)
def _(t):
    return coverage.totals(t)


@over_star(
    "q25_coverage_bands",
    f"""SELECT CASE WHEN sc >= ceil THEN '100+' WHEN sc >= 0.9 * ceil THEN '90-99' WHEN sc >= 0.5 * ceil THEN '50-89' WHEN sc >= 0.2 * ceil THEN '20-49' ELSE 'under 20' END AS band, count(*) AS places, CAST(sum(greatest(gap, 0)) AS BIGINT) AS missing FROM {COUNTED} WHERE {INSIDE} GROUP BY 1""",
)
def _(t):
    return coverage.coverage_bands(t)


@over_star(
    "q25_size_bands",
    f"""SELECT *, CASE WHEN possible > 0 THEN CAST(held AS DOUBLE) / possible END AS coverage, possible - held AS missing FROM (SELECT CASE WHEN google_reviews_total >= 1000 THEN '1000+' WHEN google_reviews_total >= 500 THEN '500-999' WHEN google_reviews_total >= 200 THEN '200-499' WHEN google_reviews_total >= 50 THEN '50-199' ELSE 'under 50' END AS band,
  count(*) AS places, CAST(sum(sc) AS BIGINT) AS held, CAST(sum(ceil) AS BIGINT) AS possible, {_n('sc >= 0.9 * ceil')} AS at_least_90 FROM {COUNTED} WHERE {INSIDE} GROUP BY 1)""",
)
def _(t):
    return coverage.size_bands(t)


@over_star("q25_coverage_by_zone", f"SELECT *, CAST(held AS DOUBLE) / possible AS coverage FROM (SELECT coalesce(zone, 'other') AS zone, count(*) AS places, CAST(sum(ceil) AS BIGINT) AS possible, CAST(sum(sc) AS BIGINT) AS held FROM {COUNTED} WHERE {INSIDE} GROUP BY 1)")
def _(t):
    return coverage.by_zone(t)


CAUSE = "CASE WHEN sc = 0 THEN 'zero' WHEN coalesce(refresh_shortfalls, 0) >= 3 THEN 'gaveup' WHEN ceil >= 850 AND sc >= 0.9 * ceil THEN 'maxed' WHEN deep_scanned_at IS NOT NULL THEN 'deep_done' WHEN ceil > 200 THEN 'need_deep' WHEN scraped_at IS NULL THEN 'queued' ELSE 'cooldown' END"


@over_star("q25_why_incomplete", f"SELECT cause, count(*) AS places, CAST(sum(gap) AS BIGINT) AS missing, list_sort(list(gap))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_gap FROM (SELECT *, {CAUSE} AS cause FROM {COUNTED} WHERE {INSIDE} AND sc < ceil) GROUP BY 1")
def _(t):
    return coverage.causes(t)


@over_star("q25_coverage_list", f"SELECT {LISTED}, CASE WHEN ceil > 0 THEN round(CAST(sc AS DOUBLE) / ceil * 100, 1) END AS percent FROM {COUNTED} WHERE {INSIDE}")
def _(t):
    return coverage.coverage_list(t)


EFF = "coalesce(nullif(r.text_clean, ''), trim(r.text))"
RANKED = f"(SELECT r.id, r.place_id, {EFF} AS eff, ar.id AS analysis_id, row_number() OVER (PARTITION BY r.place_id, {EFF} ORDER BY (ar.id IS NOT NULL) DESC, r.id) AS rn FROM reviews r LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id)"


@over_star(
    "q26_dedup_survey",
    f"""SELECT (SELECT count(*) FROM reviews) AS total_reviews, (SELECT count(*) FROM analyzed_reviews) AS total_analyzed, {_n('c > 1')} AS dup_groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra_rows, CAST(sum(lost) AS BIGINT) AS analyzed_lost
FROM (SELECT place_id, eff, count(*) AS c, count(*) FILTER (rn > 1 AND analysis_id IS NOT NULL) AS lost FROM {RANKED} GROUP BY 1, 2)""",
)
def _(t):
    return dedup.survey(t)


@over_star("q26_dedup_kept", f"SELECT id, place_id, eff FROM {RANKED} WHERE rn = 1")
def _(t):
    return dedup.kept(t)


@over_star("q26_dedup_deleted", f"SELECT (SELECT count(*) FROM {RANKED} WHERE rn = 1) AS reviews, (SELECT count(analysis_id) FROM {RANKED} WHERE rn = 1) AS analyzed")
def _(t):
    after = dedup.deleted(t)
    return after.reviews.agg(F.count(F.lit(1)).alias("reviews")).crossJoin(after.analyzed.agg(F.count(F.lit(1)).alias("analyzed")))


CASES = f"""cases AS (SELECT r.id, r.place_id, r.text_clean AS body, CASE WHEN c.ceil > 0 THEN c.sc - c.ceil END AS over FROM reviews r JOIN (SELECT text_clean FROM reviews WHERE length(coalesce(text_clean, '')) > 40 GROUP BY 1 HAVING count(DISTINCT place_id) > 1) g ON g.text_clean = r.text_clean LEFT JOIN {COUNTED} c ON c.id = r.place_id)"""


@over_star("q27_cross_place_drops", f"WITH {CASES} SELECT id AS rid, place_id AS pid, over FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY over DESC, id) AS n FROM cases WHERE over > 0) WHERE n = 1")
def _(t):
    return dedup.cross_place(t)[0]


@over_star("q27_cross_place_undecided", f"WITH {CASES} SELECT body, count(*) AS n, array_to_string(list_sort(list_distinct(list(place_id))), ',') AS pids FROM cases GROUP BY 1 HAVING NOT coalesce(max(over), 0) > 0")
def _(t):
    return dedup.cross_place(t)[1]


DIST = haversine_sql("a.lat", "a.lng", "b.lat", "b.lng", 6371000.0)


FREE = "list_filter({0}, lambda c: NOT list_contains({1}, c.keep))[1]"


@over_star(
    "q28_place_pairs",
    f"""WITH RECURSIVE pairs AS (SELECT a.id AS d, b.id AS keep, {DIST} AS dist, abs(coalesce(a.google_reviews_total, 0) - b.sc) AS off FROM {COUNTED} a JOIN {COUNTED} b ON abs(a.lat - b.lat) < 0.03
  WHERE a.google_place_id IS NOT NULL AND a.sc = 0 AND b.google_place_id IS NULL AND b.sc > 0 AND {DIST} <= 2500),
wanted AS (SELECT row_number() OVER (ORDER BY d) AS k, d, list({{'keep': keep, 'dist': dist}} ORDER BY dist, off, keep) AS choice FROM pairs GROUP BY d),
turn AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS d, CAST([] AS BIGINT[]) AS used, CAST(NULL AS STRUCT(keep BIGINT, dist DOUBLE)) AS got
  UNION ALL SELECT k, d, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.keep) END, got FROM (SELECT w.k, w.d, t.used, {FREE.format('w.choice', 't.used')} AS got FROM turn t JOIN wanted w ON w.k = t.k + 1))
SELECT d AS "drop", got.keep AS keep, round(got.dist, 3) AS dist FROM turn WHERE got IS NOT NULL""",
)
def _(t):
    return dedup.place_pairs(t, 2500.0).withColumn("dist", F.round("dist", 3))


@over_star("q28_near_twins", f"SELECT a.id AS a, b.id AS b, round({DIST}, 3) AS dist, a.sc AS a_reviews, b.sc AS b_reviews FROM {COUNTED} a JOIN {COUNTED} b ON a.id < b.id AND abs(a.lat - b.lat) < 0.02 WHERE {DIST} <= 1500")
def _(t):
    return dedup.near_twins(t, 1500.0).withColumn("dist", F.round("dist", 3))


@over_star("q28_delete_guarded", "SELECT (SELECT count(*) FROM places p WHERE p.id % 3 <> 0 OR EXISTS (SELECT 1 FROM reviews r WHERE r.place_id = p.id)) AS places, (SELECT count(*) FROM reviews) AS reviews, (SELECT count(*) FROM analyzed_reviews) AS analyzed")
def _(t):
    return _sizes(dedup.without_places(t, t.places.where("id % 3 = 0")))


@over_star("q28_delete_cascade", "SELECT (SELECT count(*) FROM places p WHERE p.id % 3 <> 0) AS places, (SELECT count(*) FROM reviews WHERE place_id NOT IN (SELECT id FROM places WHERE id % 3 = 0)) AS reviews, (SELECT count(*) FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE r.place_id NOT IN (SELECT id FROM places WHERE id % 3 = 0)) AS analyzed")
def _(t):
    return _sizes(dedup.without_places(t, t.places.where("id % 3 = 0"), force=True))


def _sizes(t):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(t.places, "places").crossJoin(one(t.reviews, "reviews")).crossJoin(one(t.analyzed, "analyzed"))


ZONE_D = ", ".join(f"{haversine_sql('{lat}', '{lng}', str(a), str(b), 6371.0)}" for a, b, _ in domain.ZONES.values())


def zone_sql(lat: str, lng: str) -> str:
    """The nearest zone within its radius, as SQL."""
    d = {z: haversine_sql(lat, lng, str(a), str(b), 6371.0) for z, (a, b, _) in domain.ZONES.items()}
    least = f"least({', '.join(d.values())})"
    return f"CASE WHEN {lat} IS NULL OR {lng} IS NULL OR {least} > 2.0 THEN 'other' " + " ".join(f"WHEN {v} = {least} THEN '{z}'" for z, v in d.items()) + " END"


DRIFT = f"""drift AS (SELECT *, {haversine_sql('lat', 'lng', 'ref_lat', 'ref_lng', 6371000.0)} AS metres, {zone_sql('ref_lat', 'ref_lng')} AS new_zone FROM (SELECT p.id, p.name, p.zone, p.lat, p.lng, c.lat AS ref_lat, c.lng AS ref_lng FROM places p JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY matched_place_id ORDER BY google_place_id) AS n FROM place_candidates WHERE matched_place_id IS NOT NULL AND lat IS NOT NULL) WHERE n = 1) c ON c.matched_place_id = p.id WHERE p.lat IS NOT NULL))"""


@over_star(
    "q29_drift_bands",
    f"""WITH {DRIFT} SELECT band, places, places / sum(places) OVER () * 100 AS percent FROM (SELECT CASE WHEN metres < 50 THEN '0-50 m' WHEN metres < 100 THEN '50-100 m' WHEN metres < 500 THEN '100-500 m' WHEN metres < 2000 THEN '500 m-2 km' WHEN metres < 10000 THEN '2-10 km' ELSE 'over 10 km' END AS band, count(*) AS places FROM drift GROUP BY 1)""",
)
def _(t):
    return audits.drift_bands(t)


@over_star("q29_zone_moves", f"WITH {DRIFT} SELECT zone AS old, new_zone AS new, count(*) AS n FROM drift WHERE metres >= 100 AND new_zone IS DISTINCT FROM zone GROUP BY 1, 2")
def _(t):
    return audits.zone_moves(t)


@over_star("q29_drift_quartiles", f"WITH {DRIFT}, s AS (SELECT list_sort(list(round(metres, 3))) AS v, count(*) AS n FROM drift) SELECT v[n // 4 + 1] AS q1, v[n // 2 + 1] AS median, v[3 * n // 4 + 1] AS q3 FROM s")
def _(t):
    return audits.quartiles(audits.drift(t).withColumn("metres", F.round("metres", 3)), "metres")


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


WORTH = f"""decision = 'new' AND google_reviews_total >= 50 AND {_any('google_types', audits.WANTED_TYPES)} AND NOT (regexp_matches(name, '(?i){audits.CHAINS}') OR regexp_matches(name, '(?i){audits.OUT_OF_SCOPE}')
  OR ({_any('google_types', ('lodging', 'shopping_mall', 'supermarket', 'department_store'))} AND NOT {_any('google_types', ('restaurant', 'cafe'))}))"""


@over_star(
    "q30_promotion_size",
    f"""SELECT count(*) AS n, CAST(coalesce(sum(least(google_reviews_total, 200)), 0) AS BIGINT) AS ref, CAST(coalesce(sum(least(google_reviews_total, 850)), 0) AS BIGINT) AS deep, {_n('formatted_address IS NULL AND opening_hours IS NULL')} AS need_det, {_n('google_reviews_total >= 850')} AS cap FROM place_candidates WHERE {WORTH}""",
)
def _(t):
    return audits.promotion_size(t)


@over_star(
    "q30_promotion_plan",
    f"""WITH c AS (SELECT * FROM place_candidates WHERE {WORTH}),
near AS (SELECT pid, id AS near_id, gpid AS near_gpid FROM (SELECT a.google_place_id AS pid, b.id, b.google_place_id AS gpid, row_number() OVER (PARTITION BY a.google_place_id ORDER BY {DIST}, b.id) AS n FROM c a JOIN places b ON abs(a.lat - b.lat) < 0.001 WHERE {DIST} <= 40 AND (b.google_place_id IS NULL OR b.google_place_id = a.google_place_id)) WHERE n = 1)
SELECT c.google_place_id, c.name, c.google_reviews_total, CASE WHEN NOT (c.lat BETWEEN 16.35 AND 17.35 AND c.lng BETWEEN 100.05 AND 101.2) THEN 'outside' WHEN near_id IS NOT NULL AND near_gpid IS NULL THEN 'fill' WHEN p.id IS NULL THEN 'insert' WHEN p.google_place_id = c.google_place_id THEN 'same' WHEN p.google_place_id IS NULL THEN 'fill' ELSE 'clash' END AS action,
  CASE WHEN near_id IS NOT NULL AND near_gpid IS NULL THEN near_id ELSE p.id END AS place_id, {zone_sql('c.lat', 'c.lng')} AS zone, round({haversine_sql('c.lat', 'c.lng', '16.7442', '100.1956', 6371.0)}, 3) AS distance_nu_km, round({haversine_sql('c.lat', 'c.lng', '16.8299369', '100.2075576', 6371.0)}, 3) AS distance_psru_km
FROM c LEFT JOIN near ON near.pid = c.google_place_id LEFT JOIN places p ON p.name = c.name""",
)
def _(t):
    return audits.promotion_plan(t)


@over_star(
    "q31_rings",
    f"""SELECT nearest_zone AS zone, CASE WHEN dist_km < 0 THEN 0 WHEN dist_km >= 4 THEN 5 ELSE CAST(floor(dist_km) AS INT) + 1 END AS ring, {_n("decision = 'new'")} AS new, {_n("decision = 'existing'")} AS old, CAST(coalesce(sum(google_reviews_total) FILTER (decision = 'new'), 0) AS BIGINT) AS reviews FROM place_candidates WHERE dist_km IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return audits.rings(t)


@over_star(
    "q31_type_honour",
    """SELECT *, CASE WHEN place_type = 'place_of_worship' THEN 'unsearchable' WHEN checked = 0 THEN 'unknown' WHEN ratio >= 0.9 THEN 'trusted' WHEN ratio >= 0.5 THEN 'check each' ELSE 'ignored' END AS verdict FROM (SELECT *, CASE WHEN checked > 0 THEN CAST(matched AS DOUBLE) / checked END AS ratio FROM (
  SELECT place_type, count(*) AS cells, CAST(sum(results) AS BIGINT) AS results, CAST(coalesce(sum(results) FILTER (type_matched IS NOT NULL), 0) AS BIGINT) AS checked, CAST(coalesce(sum(type_matched), 0) AS BIGINT) AS matched, count(*) FILTER (type_matched IS NULL) AS unchecked, count(*) FILTER (hit_cap) AS capped FROM discover_cells GROUP BY 1))""",
)
def _(t):
    return audits.type_honour(t)


CELL_RATE = "CASE WHEN results <> 0 THEN CAST(type_matched AS DOUBLE) / results END"


@over_star(
    "q31_subdivide",
    f"""WITH circles AS (SELECT DISTINCT place_type, cell_radius_m, cell_lat AS lat, cell_lng AS lng, cell_radius_m / 1000.0 AS area_km, cell_radius_m / 2000.0 AS cell_km FROM discover_cells
  WHERE hit_cap AND cell_radius_m > 100 AND place_type <> 'place_of_worship' AND NOT (type_matched IS NOT NULL AND coalesce({CELL_RATE} < 0.5, false))),
mid AS (SELECT place_type, cell_radius_m, avg(lat) AS lat0, avg(lng) AS lng0 FROM circles GROUP BY 1, 2),
placed AS (SELECT c.*, lat0, lng0, 111.32 * cos(radians(lat0)) AS km_lng, cell_km * sqrt(3) AS step, cell_km * 1.5 AS h, area_km + cell_km AS reach FROM circles c JOIN mid USING (place_type, cell_radius_m)),
xy AS (SELECT *, (lng - lng0) * km_lng AS x, (lat - lat0) * 110.574 AS y FROM placed),
grid AS (SELECT xy.*, i.i, j.j FROM xy, range(-400, 401) i(i), range(-400, 401) j(j) WHERE abs(i.i * h - y) <= reach + h AND abs(j.j * step - x) <= reach + step),
cells AS (SELECT DISTINCT place_type, cell_radius_m, round(lat0 + i * h / 110.574, 6) AS lat, round(lng0 + (j * step + CASE WHEN i % 2 <> 0 THEN step / 2 ELSE 0 END) / km_lng, 6) AS lng FROM grid
  WHERE sqrt((j * step + CASE WHEN i % 2 <> 0 THEN step / 2 ELSE 0 END - x) ** 2 + (i * h - y) ** 2) <= reach)
SELECT lat, lng, place_type, CAST(cell_radius_m // 2 AS INT) AS radius_m FROM cells c WHERE NOT EXISTS (SELECT 1 FROM discover_cells d WHERE d.status IN ('OK', 'ZERO_RESULTS') AND round(d.cell_lat, 6) = c.lat AND round(d.cell_lng, 6) = c.lng AND d.place_type = c.place_type AND d.cell_radius_m = c.cell_radius_m // 2)""",
)
def _(t):
    return audits.subdivide(t.cells.sparkSession, t)


@over_star("q32_refresh_queue", f"SELECT id, name, scraped_at, CASE WHEN consecutive_no_change >= 3 THEN 30 WHEN consecutive_no_change = 2 THEN 14 ELSE 7 END AS cooldown_days FROM places WHERE NOT scrape_excluded AND (scraped_at IS NULL OR {AS_OF} - scraped_at > CASE WHEN consecutive_no_change >= 3 THEN 30 WHEN consecutive_no_change = 2 THEN 14 ELSE 7 END)")
def _(t):
    return coverage.refresh_queue(t, star.AS_OF)


@over_star("q32_round_yield", f"SELECT *, coalesce(ratio < 0.4, false) AS stop FROM (SELECT *, CASE WHEN expected >= 200 THEN CAST(got AS DOUBLE) / expected END AS ratio FROM (SELECT CAST(coalesce(sum(sc), 0) AS BIGINT) AS got, CAST(coalesce(sum(ceil), 0) AS BIGINT) AS expected FROM {COUNTED} WHERE scraped_at >= DATE '2001-07-20' AND google_reviews_total >= 50))")
def _(t):
    return coverage.round_yield(t, date(2001, 7, 20))


SPAN = "(SELECT place_id, max(review_date_approx) - min(review_date_approx) AS span FROM reviews GROUP BY 1)"


def _deep(where: str, attempts: str = "<") -> str:
    return f"SELECT {LISTED} FROM {COUNTED} c LEFT JOIN {SPAN} s ON s.place_id = c.id WHERE NOT scrape_excluded AND coalesce(deep_attempts, 0) {attempts} 3 AND {where}"


@over_star("q32_deep_targets", _deep("deep_scanned_at IS NULL AND (sc >= 190 OR sc = 0 OR (sc >= 50 AND span < 730))"))
def _(t):
    return coverage.deep_targets(t)


@over_star("q32_deep_targets_gap", _deep("ceil > 200 AND gap >= 50") + " ORDER BY gap DESC, name LIMIT 25")
def _(t):
    return coverage.deep_targets(t, "gap", limit=25)


@over_star("q32_deep_given_up", _deep("deep_scanned_at IS NULL AND sc = 0", ">="))
def _(t):
    return coverage.deep_targets(t, "zero", given_up=True)


@over_star("q32_requeue", f"SELECT {LISTED}, consecutive_no_change, refresh_shortfalls FROM {COUNTED} WHERE {INSIDE} AND scraped_at IS NOT NULL AND google_reviews_total >= 50 AND coalesce(refresh_shortfalls, 0) < 3 AND sc < 0.5 * ceil")
def _(t):
    return coverage.requeue(t)


@over_star("q32_stuck", f"SELECT {LISTED}, consecutive_no_change FROM {COUNTED} WHERE NOT scrape_excluded AND scraped_at IS NULL AND coalesce(consecutive_no_change, 0) >= 3")
def _(t):
    return coverage.stuck(t)


@over_star("q32_false_deep", f"SELECT {LISTED}, deep_attempts FROM {COUNTED} WHERE {INSIDE} AND deep_scanned_at IS NOT NULL AND sc < 0.5 * ceil")
def _(t):
    return coverage.false_deep(t)


@over_star("q32_spent_attempts", f"SELECT {LISTED}, deep_attempts FROM {COUNTED} WHERE {INSIDE} AND coalesce(deep_attempts, 0) >= 3 AND sc < 0.8 * ceil")
def _(t):
    return coverage.spent_attempts(t)


@over_star("q33_dirty_labels", f"SELECT ar.pain_point_category AS cat, count(*) AS n FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE NOT ({HT}) AND ar.pain_point_category IS NOT NULL AND ar.pain_point_category <> '{domain.GENERAL}' GROUP BY 1")
def _(t):
    return dedup.dirty_labels(t)


@over_star("q33_unsupported_keywords", "SELECT r.id, ar.keywords FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE len(list_filter(string_split(ar.keywords, '|'), lambda k: k IN ('word1', 'word2', 'text') AND NOT contains(coalesce(r.text_clean, ''), k))) > 0")
def _(t):
    own = type(t)(t.places, t.reviews, t.analyzed.withColumn("keywords", F.split("keywords", "[|]")))
    return dedup.unsupported_keywords(own, ("word1", "word2", "text")).withColumn("keywords", F.array_join("keywords", "|"))


@over_star(
    "q34_exclusion_candidates",
    f"""SELECT id, name, zone, google_reviews_total, sc, reason FROM (SELECT *, CASE WHEN contains(google_types, 'lodging') AND NOT {_any('google_types', ('restaurant', 'cafe'))} THEN 'lodging'
  WHEN (contains(google_types, ',political') OR google_types LIKE 'political%' OR {_any('google_types', ('locality', 'administrative_area_level'))}) AND NOT {_any('google_types', ('restaurant', 'cafe', 'lodging', 'tourist_attraction'))} THEN 'area' END AS reason FROM {COUNTED} WHERE NOT scrape_excluded) WHERE reason IS NOT NULL""",
)
def _(t):
    return audits.exclusion_candidates(t)


@over_star(
    "q34_dirty_categories",
    "SELECT id, name, google_category, CASE "
    + " ".join(f"WHEN list_contains(string_split(google_types, ','), '{k}') THEN '{v}'" for k, v in audits.TYPE_CATEGORIES)
    + " END AS new_category FROM places WHERE google_category IS NULL OR google_category = '' OR google_category = 'เพิ่มเว็บไซต์'",
)
def _(t):
    return audits.dirty_categories(t)


@over_star(
    "q35_missing_dates",
    """SELECT id, scraped_at - days AS date, phrase, source FROM (SELECT id, scraped_at, coalesce(review_date, concat(CAST(id % 11 + 1 AS VARCHAR), CASE id % 4 WHEN 0 THEN ' เดือนที่แล้ว' WHEN 1 THEN ' weeks ago' WHEN 2 THEN ' ปีที่แล้ว' ELSE ' วันที่แล้ว' END)) AS phrase, CASE WHEN review_date IS NULL THEN 'text' ELSE 'review_date' END AS source,
  CASE WHEN review_date = 'a week ago' THEN 7 WHEN review_date IS NOT NULL THEN 90 WHEN id % 4 = 0 THEN (id % 11 + 1) * 30 WHEN id % 4 = 1 AND id % 11 + 1 <= 8 THEN (id % 11 + 1) * 7 WHEN id % 4 = 2 THEN (id % 11 + 1) * 365 WHEN id % 4 = 3 THEN id % 11 + 1 END::INT AS days FROM reviews WHERE review_date_approx IS NULL) WHERE days IS NOT NULL""",
)
def _(t):
    return audits.missing_dates(t)


@over_star("q35_impossible_dates", f"SELECT {_n('review_date_approx > ' + AS_OF)} AS future, {_n('''review_date_approx < DATE '2008-01-01' ''')} AS before_2008, {_n('review_date_approx > scraped_at')} AS after_scan FROM reviews")
def _(t):
    return audits.impossible_dates(t, star.AS_OF)


@over_star("q36_zone_counts", "SELECT coalesce(zone, 'other') AS zone, count(*) AS places, count(lat) AS with_coordinates, round(avg(overall_rating), 2) AS avg_rating FROM places GROUP BY 1")
def _(t):
    return audits.zone_counts(t)


@over_star("q36_table_counts", "SELECT 'places' AS table_name, count(*) AS n FROM places UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'analyzed_reviews', count(*) FROM analyzed_reviews")
def _(t):
    return audits.table_counts(t)


@over_star("q36_completeness", "SELECT count(*) AS n, " + ", ".join(f"count({c}) AS has_{c}" for c in ("google_place_id", "google_types", "google_reviews_total", "overall_rating", "lat", "zone", "scraped_at", "deep_scanned_at", "business_status")) + " FROM places")
def _(t):
    return audits.completeness(t)


@over_star("q36_total_quartiles", "WITH s AS (SELECT list_sort(list(google_reviews_total)) AS v, count(*) AS n FROM places WHERE google_reviews_total IS NOT NULL) SELECT v[n // 4 + 1] AS q1, v[n // 2 + 1] AS median, v[3 * n // 4 + 1] AS q3 FROM s")
def _(t):
    return audits.quartiles(t.places, "google_reviews_total")


@over_star("q36_date_span", "SELECT min(review_date_approx) AS first, max(review_date_approx) AS last, count(review_date_approx) AS dated, count(*) AS reviews, round(avg(length(text_clean)), 2) AS avg_length FROM reviews")
def _(t):
    return audits.date_span(t)


@over_star("q36_shared_external_ids", "SELECT google_place_id, count(*) AS n, string_agg(name, ' | ' ORDER BY name) AS names FROM (SELECT concat('gp', CAST(id % 400 AS STRING)) AS google_place_id, name FROM places) GROUP BY 1 HAVING count(*) > 1".replace("AS STRING", "AS VARCHAR"))
def _(t):
    return audits.shared_external_ids(type(t)(t.places.withColumn("google_place_id", F.concat(F.lit("gp"), (F.col("id") % 400).cast("string"))), t.reviews, t.analyzed))


@over_star("q36_external_id_owners", "SELECT w.google_place_id, w.id, p.id AS owner_id FROM (SELECT id + 1 AS id, google_place_id FROM places WHERE id % 50 = 1) w JOIN places p ON p.google_place_id = w.google_place_id WHERE p.id <> w.id")
def _(t):
    return audits.owners_of(t, t.places.where("id % 50 = 1").select((F.col("id") + 1).alias("id"), "google_place_id"))


@over_star(
    "w04_trailing_known",
    "WITH m AS (SELECT place_id, row_number() OVER (PARTITION BY place_id ORDER BY id) AS pos, id % 7 <> 0 AS known FROM reviews) SELECT place_id, max(pos) - coalesce(max(pos) FILTER (NOT known), 0) AS trailing_known FROM m GROUP BY 1",
)
def _(t):
    from pyspark.sql import Window

    rows = t.reviews.select("place_id", F.row_number().over(Window.partitionBy("place_id").orderBy("id")).cast("long").alias("pos"), F.col("id").alias("h"))
    return audits.trailing_known(rows, t.reviews.where("id % 7 <> 0").select(F.col("id").alias("h")))


@over_star(
    "j14_nearest_zone",
    "SELECT id, round(least({0}), 3) AS km, CASE ".format(", ".join(haversine_sql("lat", "lng", str(a), str(b), 6371.0) for a, b, _ in domain.ZONES.values()))
    + " ".join("WHEN {0} = least({1}) THEN '{2}'".format(haversine_sql("lat", "lng", str(a), str(b), 6371.0), ", ".join(haversine_sql("lat", "lng", str(c), str(d), 6371.0) for c, d, _ in domain.ZONES.values()), z) for z, (a, b, _) in domain.ZONES.items())
    + " END AS nearest, "
    + zone_sql("lat", "lng")
    + " AS zone_2km FROM places WHERE lat IS NOT NULL",
)
def _(t):
    near = geo.nearest_zone(F.col("lat"), F.col("lng"))
    return t.places.where("lat IS NOT NULL").select("id", F.round(near["d"], 3).alias("km"), near["zone"].alias("nearest"), geo.assign_zone(F.col("lat"), F.col("lng")).alias("zone_2km"))


@over_star(
    "s05_upsert_places",
    """SELECT coalesce(o.id, n.id) AS id, coalesce(n.overall_rating, o.overall_rating) AS overall_rating, coalesce(o.zone, n.zone) AS zone, coalesce(n.business_status, o.business_status) AS business_status
FROM (SELECT * FROM places WHERE id % 5 <> 0) o FULL JOIN (SELECT id, CASE WHEN id % 2 = 0 THEN 5.0 END AS overall_rating, 'new' AS zone, CASE WHEN id % 3 = 0 THEN 'operational' END AS business_status FROM places WHERE id % 5 < 2) n ON o.id = n.id""",
)
def _(t):
    old = t.places.where("id % 5 <> 0").select("id", "overall_rating", "zone", "business_status")
    new = t.places.where("id % 5 < 2").selectExpr("id", "CASE WHEN id % 2 = 0 THEN 5.0D END AS overall_rating", "'new' AS zone", "CASE WHEN id % 3 = 0 THEN 'operational' END AS business_status")
    return upserts.upsert(old, new, ["id"], prefer_old=("zone",))


@over_star("s06_insert_ignore", "SELECT place_id, text_clean, min(id) AS id FROM reviews r WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM reviews o WHERE o.id % 2 = 1 AND o.place_id = r.place_id AND o.text_clean = r.text_clean) GROUP BY 1, 2")
def _(t):
    rows = t.reviews.select("id", "place_id", "text_clean")
    return upserts.insert_ignore(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), ["place_id", "text_clean"], first_by="id")


@over_star(
    "s09_candidates_seen_again",
    """SELECT coalesce(o.google_place_id, n.google_place_id) AS google_place_id, coalesce(o.source_type, n.source_type) AS source_type, coalesce(o.seen_count, 0) + coalesce(n.seen_count, 0) AS seen_count, CASE WHEN n.google_place_id IS NOT NULL THEN DATE '2001-08-02' ELSE DATE '2001-01-01' END AS last_seen_at,
  CASE WHEN o.google_place_id IS NOT NULL THEN DATE '2001-01-01' ELSE DATE '2001-08-02' END AS first_seen_at
FROM (SELECT google_place_id, source_type, 1 AS seen_count FROM place_candidates WHERE decision <> 'reject') o FULL JOIN (SELECT google_place_id, 'cafe' AS source_type, 1 AS seen_count FROM place_candidates WHERE google_reviews_total % 2 = 0) n ON o.google_place_id = n.google_place_id""",
)
def _(t):
    c = t.candidates
    old = c.where("decision <> 'reject'").selectExpr("google_place_id", "source_type", "1L AS seen_count", "DATE '2001-01-01' AS first_seen_at", "DATE '2001-01-01' AS last_seen_at")
    return upserts.seen_again(old, c.where("google_reviews_total % 2 = 0").selectExpr("google_place_id", "'cafe' AS source_type"), star.AS_OF)


@over_star(
    "t06_scan_stats",
    f"""SELECT p.id, CASE WHEN p.id % 4 = 0 THEN greatest(coalesce(h.sc, 0) - coalesce(last_review_count, 0), 0) END AS last_scan_new_reviews, CASE WHEN p.id % 4 <> 0 THEN consecutive_no_change WHEN coalesce(h.sc, 0) > coalesce(last_review_count, 0) THEN 0 ELSE consecutive_no_change + 1 END AS consecutive_no_change,
  CASE WHEN p.id % 4 = 0 THEN coalesce(h.sc, 0) ELSE last_review_count END AS last_review_count FROM places p LEFT JOIN {HELD} h ON h.place_id = p.id""",
)
def _(t):
    return upserts.scan_stats(t.places, t.reviews, t.places.where("id % 4 = 0").select("name")).select("id", "last_scan_new_reviews", "consecutive_no_change", "last_review_count")


@over_star("t07_scan_failures", "SELECT id, CASE WHEN id % 6 = 0 THEN 0 WHEN id % 3 = 0 THEN coalesce(refresh_shortfalls, 0) + 1 ELSE refresh_shortfalls END AS refresh_shortfalls, coalesce(CASE WHEN id % 6 = 0 THEN 0 WHEN id % 3 = 0 THEN coalesce(refresh_shortfalls, 0) + 1 ELSE refresh_shortfalls END >= 3, false) AS given_up FROM places")
def _(t):
    return upserts.scan_failures(t.places, t.places.where("id % 3 = 0"), t.places.where("id % 6 = 0")).select("id", "refresh_shortfalls", "given_up")


@over_star("s18_restore", "SELECT id, CASE WHEN id % 9 = 0 THEN concat('old ', CAST(id AS VARCHAR)) ELSE zone END AS zone FROM places")
def _(t):
    backup = t.places.where("id % 9 = 0").select("id", F.concat(F.lit("old "), F.col("id").cast("string")).alias("value"))
    return upserts.restore(t.places.select("id", "zone"), "id", "zone", backup)
