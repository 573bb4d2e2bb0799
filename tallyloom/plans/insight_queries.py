"""Insights, places, reviews, snapshots and reports over the review star."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyloom.functions import domain
from tallyloom.operators import insights, places, report, snapshots
from tallyloom.plans import star
from tallyloom.plans.registry import over_star

NP = "(" + ", ".join(f"'{c}'" for c in domain.NON_PROBLEM) + ")"
OPEN = "coalesce(p.business_status, 'operational') = 'operational'"
HT = "coalesce(r.text_clean, '') <> ''"
BASE = "FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id JOIN places p ON p.id = r.place_id"
LABEL = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in domain.ZONE_LABELS.items()) + " ELSE {} END"
NEG = "ar.sentiment = 'negative'"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"


def _zone_sql(dates: str) -> str:
    how = "JOIN" if dates else "LEFT JOIN"
    return f"""
SELECT *, {LABEL.format('zone', 'zone')} AS label, {_rate('negative_count', 'total_with_text')} AS complaint_rate FROM (
SELECT coalesce(p.zone, 'other') AS zone, count(DISTINCT p.id) AS place_count, count(r.id) AS review_count, count(ar.id) AS analyzed_count,
  count(*) FILTER ({NEG} AND ar.severity = 'high' AND {HT}) AS high_count, count(*) FILTER ({NEG} AND ar.severity = 'medium' AND {HT}) AS medium_count,
  count(*) FILTER ({NEG} AND ar.severity = 'low' AND {HT}) AS low_count,
  mode() WITHIN GROUP (ORDER BY CASE WHEN {NEG} AND {HT} AND ar.pain_point_category NOT IN {NP} THEN ar.pain_point_category END) AS top_category,
  count(*) FILTER (ar.id IS NOT NULL AND {HT}) AS total_with_text, count(*) FILTER ({NEG} AND {HT}) AS negative_count
FROM places p {how} reviews r ON r.place_id = p.id {dates} LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id
WHERE {OPEN} GROUP BY coalesce(p.zone, 'other'))"""


@over_star("q01_zone_summary", _zone_sql(""))
def _(t):
    return insights.zone_summary(t)


@over_star("q01_zone_summary_dates", _zone_sql("AND r.review_date_approx BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"))
def _(t):
    return insights.zone_summary(t, "1997-01-01", "1999-12-31")


def _shares_sql(where: str, view: str) -> str:
    share = _rate("count", "negative") if view == "complaints" else "CAST(NULL AS DOUBLE)"
    kind = {"complaints": f"AND {NEG} AND ar.pain_point_category NOT IN {NP}", "praise": f"AND ar.sentiment = 'positive' AND ar.pain_point_category NOT IN {NP}"}.get(view, "")
    return f"""
WITH base AS (SELECT count(*) AS total_with_text, count(*) FILTER ({NEG}) AS negative, count(*) FILTER (ar.sentiment = 'positive') AS positive, count(*) FILTER (ar.sentiment = 'neutral') AS neutral,
  count(*) FILTER ({NEG} AND ar.severity = 'high') AS negative_high, count(*) FILTER ({NEG} AND ar.severity = 'medium') AS negative_medium, count(*) FILTER ({NEG} AND ar.severity = 'low') AS negative_low {BASE} WHERE {HT} AND {where}),
top AS (SELECT ar.pain_point_category AS category, count(*) AS count {BASE} WHERE {HT} AND {where} AND ar.pain_point_category IS NOT NULL {kind} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT *, {share} AS share_of_negative, {_rate('count', 'total_with_text')} AS rate_of_all, {_rate('negative', 'total_with_text')} AS complaint_rate,
  {_rate('negative_high', 'negative')} AS share_high, {_rate('negative_medium', 'negative')} AS share_medium, {_rate('negative_low', 'negative')} AS share_low FROM top, base"""


@over_star("q02_zone_pain_points", _shares_sql(f"{OPEN} AND coalesce(p.zone, 'other') = 'naresuan'", "complaints"))
def _(t):
    return insights.category_shares(t, zone="naresuan")


@over_star("q02_zone_pain_points_praise", _shares_sql("coalesce(p.zone, 'other') = 'other'", "praise"))
def _(t):
    return insights.category_shares(t, "praise", "all", zone="other")


@over_star("q02_zone_pain_points_all_closed", _shares_sql("coalesce(p.business_status, 'operational') IN ('closed_permanently', 'closed_temporarily') AND coalesce(p.zone, 'other') = 'city_center'", "all"))
def _(t):
    return insights.category_shares(t, "all", "closed", zone="city_center")


def _type_sql(name: str, category: str) -> str:
    c = f"lower(trim({category}))"
    whole = " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in insights.TYPE_OF_CATEGORY.items())
    part = " ".join(f"WHEN contains({c}, '{k}') THEN '{v}'" for k, v in insights.TYPE_OF_CATEGORY.items())
    named = " ".join(f"WHEN contains(lower({name}), '{w}') THEN '{t}'" for t, words in insights.TYPE_OF_NAME for w in words)
    return f"CASE {whole} {part} {named} ELSE 'ทั่วไป' END"


@over_star(
    "q03_zone_breakdown",
    f"""
WITH per_place AS (SELECT p.id, p.name, {_type_sql('p.name', 'p.google_category')} AS type, count(*) FILTER ({NEG} AND ar.severity = 'high') AS high, count(*) FILTER ({NEG} AND ar.severity = 'medium') AS medium, count(*) FILTER ({NEG} AND ar.severity = 'low') AS low
  FROM places p LEFT JOIN reviews r ON r.place_id = p.id LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE {OPEN} AND coalesce(p.zone, 'other') = 'naresuan' GROUP BY p.id, p.name, p.google_category),
types AS (SELECT type, count(*) AS place_count, CAST(sum(high) AS BIGINT) AS high_total, CAST(sum(medium) AS BIGINT) AS medium_total, CAST(sum(low) AS BIGINT) AS low_total FROM per_place GROUP BY type),
worst AS (SELECT type, string_agg(name || ':' || high, '|' ORDER BY n) AS top_places FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY high DESC, name) AS n FROM per_place) WHERE n <= 5 GROUP BY type),
pains AS (SELECT type, string_agg(category || ':' || c, '|' ORDER BY n) AS top_pain_points FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY c DESC, category) AS n FROM (
  SELECT {_type_sql('p.name', 'p.google_category')} AS type, ar.pain_point_category AS category, count(*) AS c {BASE} WHERE {HT} AND {OPEN} AND coalesce(p.zone, 'other') = 'naresuan' AND {NEG} AND ar.pain_point_category NOT IN {NP} GROUP BY 1, 2)) WHERE n <= 5 GROUP BY type)
SELECT types.*, top_places, top_pain_points FROM types LEFT JOIN worst USING (type) LEFT JOIN pains USING (type)""",
)
def _(t):
    rows = insights.zone_breakdown(t, "naresuan")
    flat = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b].cast("string"))), "|")
    return rows.withColumns({"top_places": flat("top_places", "name", "high_count"), "top_pain_points": flat("top_pain_points", "category", "count")}).drop("type_order")


def _category_places_sql(where: str) -> str:
    return f"""
SELECT p.id AS place_id, p.name AS place_name, coalesce(p.zone, 'other') AS zone, coalesce(p.business_status, 'operational') AS business_status, count(*) AS total,
  count(*) FILTER (ar.severity = 'high') AS high, count(*) FILTER (ar.severity = 'medium') AS medium, count(*) FILTER (ar.severity = 'low') AS low,
  count(*) FILTER ({NEG}) AS neg, count(*) FILTER (ar.sentiment = 'positive') AS pos, count(*) FILTER (ar.sentiment NOT IN ('negative', 'positive') OR ar.sentiment IS NULL) AS neu
{BASE} WHERE {HT} AND {where} GROUP BY 1, 2, 3, 4 ORDER BY total DESC, place_id LIMIT 50"""


@over_star("q04_category_places", _category_places_sql(f"{OPEN} AND {NEG} AND ar.pain_point_category NOT IN {NP}"))
def _(t):
    return insights.category_places(t)


@over_star("q04_category_places_all", _category_places_sql("coalesce(p.zone, 'other') = 'rajabhat' AND ar.pain_point_category = 'ความปลอดภัย'"))
def _(t):
    return insights.category_places(t, "ความปลอดภัย", "rajabhat", "all", "all")


def _category_reviews_sql(where: str) -> str:
    return f"""
SELECT r.id, r.text_clean AS text, r.rating, ar.severity, ar.sentiment, r.review_date_approx AS date FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE {HT} AND {where}
ORDER BY CASE ar.severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, r.review_date_approx DESC NULLS LAST, r.id DESC LIMIT 30"""


@over_star("q05_category_reviews", _category_reviews_sql(f"r.place_id = 7 AND {NEG} AND ar.pain_point_category NOT IN {NP}"))
def _(t):
    return insights.category_reviews(t, 7)


@over_star("q05_category_reviews_neutral", _category_reviews_sql("r.place_id = 10 AND (ar.sentiment NOT IN ('negative', 'positive') OR ar.sentiment IS NULL)"))
def _(t):
    return insights.category_reviews(t, 10, sentiment="neutral", view="all")


@over_star(
    "q06_summary_totals",
    f"""
WITH counted AS (SELECT count(*) AS total_reviews, count(ar.id) AS total_analyzed, count(*) FILTER (ar.id IS NOT NULL AND {HT}) AS total_with_text, count(*) FILTER ({NEG} AND {HT}) AS negative,
  count(*) FILTER (ar.sentiment = 'positive' AND {HT}) AS positive, count(*) FILTER (ar.sentiment = 'neutral' AND {HT}) AS neutral, count(*) FILTER ({NEG} AND ar.severity = 'high' AND {HT}) AS negative_high,
  count(*) FILTER ({NEG} AND ar.severity = 'medium' AND {HT}) AS negative_medium, count(*) FILTER ({NEG} AND ar.severity = 'low' AND {HT}) AS negative_low
  FROM reviews r JOIN places p ON p.id = r.place_id LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE {OPEN} AND r.review_date_approx >= DATE '1998-01-01')
SELECT (SELECT count(*) FROM places p WHERE {OPEN}) AS total_places, *, {_rate('negative', 'total_with_text')} AS complaint_rate FROM counted""",
)
def _(t):
    return insights.totals(t, date_from="1998-01-01", date_to="1999-99-01")


@over_star("q06_summary_categories", _shares_sql(OPEN, "complaints"))
def _(t):
    return insights.category_shares(t)


@over_star("q06_severity_distribution", f"SELECT ar.severity, count(*) AS count FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE ar.severity IS NOT NULL AND {NEG} GROUP BY 1")
def _(t):
    return insights.severity_distribution(t)


@over_star("q06_worst_places", f"SELECT p.id AS place_id, p.name AS place_name, count(*) FILTER ({NEG} AND ar.severity = 'high') AS high_count {BASE} GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def _(t):
    return insights.worst_places(t)


def _top_places_sql(rest: str) -> str:
    return f"""
SELECT *, {_rate('high_count', 'review_count')} AS high_rate FROM (SELECT p.id, p.name, p.overall_rating, coalesce(p.business_status, 'operational') AS business_status, count(*) FILTER ({HT}) AS review_count,
  count(*) FILTER ({NEG} AND ar.severity = 'high' AND {HT}) AS high_count, count(*) FILTER ({NEG} AND ar.severity = 'medium' AND {HT}) AS medium_count {BASE} WHERE {OPEN} GROUP BY 1, 2, 3, 4) {rest}"""


@over_star("q07_top_places", _top_places_sql("ORDER BY high_count DESC, medium_count DESC, id LIMIT 10"))
def _(t):
    return insights.top_places(t)


@over_star("q07_top_places_rate", _top_places_sql("WHERE review_count >= 5 ORDER BY high_rate DESC NULLS LAST, high_count DESC, id LIMIT 10"))
def _(t):
    return insights.top_places(t, sort="rate", min_reviews=5)


@over_star(
    "q08_positive_highlights",
    f"""
WITH c AS (SELECT ar.pain_point_category AS category, count(*) AS count {BASE} WHERE ar.sentiment = 'positive' AND {HT} AND ar.pain_point_category NOT IN {NP} AND {OPEN} GROUP BY 1)
SELECT category, count, (SELECT CAST(coalesce(sum(count), 0) AS BIGINT) FROM c) AS total_praise, CAST(count AS DOUBLE) / (SELECT sum(count) FROM c) AS share_of_praise FROM c ORDER BY count DESC, category LIMIT 5""",
)
def _(t):
    return insights.positive_highlights(t)


SNAP_DAYS = {1: "1999-06-30", 2: "1999-12-31"}
CATS = f"""cats AS (SELECT CASE WHEN grouping(zone) = 1 THEN NULL ELSE zone END AS zone, category, sid AS snapshot_id, count(*) FILTER (s = 'negative') AS complaint_count, count(*) FILTER (s = 'positive') AS praise_count,
  count(*) FILTER (s = 'negative' AND severity = 'high') AS high_count, count(*) FILTER (s = 'negative' AND severity = 'medium') AS medium_count, count(*) FILTER (s = 'negative' AND severity = 'low') AS low_count
  FROM (SELECT coalesce(p.zone, 'other') AS zone, ar.pain_point_category AS category, ar.sentiment AS s, ar.severity, d.sid {BASE} JOIN (VALUES (1, DATE '{SNAP_DAYS[1]}'), (2, DATE '{SNAP_DAYS[2]}')) d(sid, day) ON r.review_date_approx <= d.day
  WHERE ar.pain_point_category IS NOT NULL AND {HT}) GROUP BY GROUPING SETS ((category, sid), (zone, category, sid)))"""
SPLACES = f"""splaces AS (SELECT r.place_id, ar.pain_point_category AS category, d.sid AS snapshot_id, count(*) FILTER ({NEG}) AS complaint_count, count(*) FILTER (ar.sentiment = 'positive') AS praise_count, count(*) FILTER ({NEG} AND ar.severity = 'high') AS high_count
  FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id JOIN (VALUES (1, DATE '{SNAP_DAYS[1]}'), (2, DATE '{SNAP_DAYS[2]}')) d(sid, day) ON r.review_date_approx <= d.day WHERE ar.pain_point_category IS NOT NULL AND {HT} GROUP BY 1, 2, 3)"""


def _days() -> dict[int, date]:
    return {k: date.fromisoformat(v) for k, v in SNAP_DAYS.items()}


def snapshot_tables(t):
    cats, plcs = None, None
    for sid, day in _days().items():
        c, p = snapshots.categories(t, sid, day), snapshots.places(t, sid, day)
        cats, plcs = (c, p) if cats is None else (cats.unionByName(c), plcs.unionByName(p))
    return cats, plcs


HEADERS = f"""
SELECT CAST(d.sid AS BIGINT) AS id, d.label AS period_label, (SELECT count(*) FROM places) AS total_places, (SELECT count(*) FROM reviews r WHERE d.day IS NULL OR r.review_date_approx <= d.day) AS total_reviews,
  (SELECT count(*) FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE d.day IS NULL OR r.review_date_approx <= d.day) AS total_analyzed, CAST(NULL AS VARCHAR) AS note
FROM (VALUES (1, DATE '{SNAP_DAYS[1]}', 'a'), (2, DATE '{SNAP_DAYS[2]}', 'b'), (3, NULL, 'c')) d(sid, day, label)"""


def _headers(t):
    days = [(1, "a", _days()[1]), (2, "b", _days()[2]), (3, "c", None)]
    out = None
    for sid, label, day in days:
        one = snapshots.header(t, sid, label, day)
        out = one if out is None else out.unionByName(one)
    return out


@over_star("q24_snapshot_headers", HEADERS)
def _(t):
    return _headers(t)


@over_star("q09_list_snapshots", HEADERS + " ORDER BY id DESC LIMIT 2")
def _(t):
    return snapshots.latest(_headers(t).withColumn("taken_at", F.col("id")), 2).drop("taken_at")


@over_star("q24_snapshot_categories", f"WITH {CATS} SELECT *  REPLACE (CAST(snapshot_id AS BIGINT) AS snapshot_id) FROM cats")
def _(t):
    return snapshot_tables(t)[0]


@over_star("q24_snapshot_places", f"WITH {SPLACES} SELECT * REPLACE (CAST(snapshot_id AS BIGINT) AS snapshot_id) FROM splaces")
def _(t):
    return snapshot_tables(t)[1]


@over_star("q24_snapshot_sizes", f"WITH {CATS} SELECT h.*, (SELECT count(*) FROM cats WHERE snapshot_id = h.id) AS n_rows FROM ({HEADERS.replace('WITH', '')}) h")
def _(t):
    return snapshots.with_sizes(_headers(t), snapshot_tables(t)[0])


def _compare(zone: str | None, least: int) -> str:
    z = "zone IS NULL" if zone is None else f"zone = '{zone}'"
    return f"""{CATS}, {SPLACES},
both_ AS (SELECT coalesce(a.category, b.category) AS category, coalesce(b.complaint_count, 0) AS before, coalesce(a.complaint_count, 0) AS after, coalesce(a.high_count, 0) AS high_count
  FROM (SELECT * FROM cats WHERE snapshot_id = 2 AND {z}) a FULL JOIN (SELECT * FROM cats WHERE snapshot_id = 1 AND {z}) b ON a.category = b.category),
gains AS (SELECT coalesce(a.category, b.category) AS category, p.name, coalesce(a.complaint_count, 0) - coalesce(b.complaint_count, 0) AS gain
  FROM (SELECT * FROM splaces WHERE snapshot_id = 2) a FULL JOIN (SELECT * FROM splaces WHERE snapshot_id = 1) b ON a.place_id = b.place_id AND a.category = b.category JOIN places p ON p.id = coalesce(a.place_id, b.place_id)
  WHERE coalesce(a.complaint_count, 0) > coalesce(b.complaint_count, 0)),
wh AS (SELECT category, count(*) AS places_increased, max(gain) AS most, sum(gain) AS whole, string_agg(CASE WHEN n <= 3 THEN name || ':' || gain END, '|' ORDER BY n) AS top_places, max(CASE WHEN n = 1 THEN name END) AS top_name, max(CASE WHEN n = 1 THEN gain END) AS top_gain
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY gain DESC, name) AS n FROM gains) GROUP BY category),
cmp AS (SELECT category, before, after, after - before AS delta, CASE WHEN before > 0 THEN round_even(CAST(after - before AS DOUBLE) / before * 100, 1) END AS pct_change, high_count,
  CASE WHEN places_increased = 1 OR most / whole >= 0.6 THEN 'concentrated' ELSE 'widespread' END AS spread, coalesce(places_increased, 0) AS places_increased, top_places, top_name, top_gain
  FROM both_ LEFT JOIN wh USING (category) WHERE after - before >= {least} AND category NOT IN {NP})"""


def _flat(df):
    return df.withColumn("top_places", F.array_join(F.transform("top_places", lambda x: F.concat(x["place_name"], F.lit(":"), x["delta"].cast("string"))), "|"))


@over_star("q10_snapshot_compare", f"WITH {_compare(None, 1)} SELECT * EXCLUDE (top_name, top_gain) FROM cmp")
def _(t):
    return _flat(snapshots.compare(t, *snapshot_tables(t), 1, 2))


@over_star("q10_snapshot_compare_zone", f"WITH {_compare('naresuan', 1)} SELECT * EXCLUDE (top_name, top_gain) FROM cmp")
def _(t):
    return _flat(snapshots.compare(t, *snapshot_tables(t), 1, 2, "naresuan"))


@over_star(
    "q12_alerts",
    f"""WITH {_compare(None, 2)}, typed AS (SELECT *, CASE WHEN before = 0 AND after > 0 THEN 'new_category' WHEN spread = 'concentrated' AND top_name IS NOT NULL THEN 'spike' ELSE 'increase' END AS type FROM cmp)
SELECT type || ':' || category AS id, type, CASE WHEN type = 'new_category' OR (type = 'spike' AND delta >= 5) THEN 'high' WHEN type = 'spike' OR delta >= 5 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN type = 'new_category' THEN 'ปัญหาใหม่: ' || category ELSE category || ' เพิ่มขึ้น ' || delta || ' คอมเมนต์' END AS title,
  CASE type WHEN 'new_category' THEN 'เพิ่งพบครั้งแรก ' || after || ' คอมเมนต์' WHEN 'spike' THEN 'กระจุกที่ร้านเดียว — ' || top_name || ' (+' || top_gain || ')' ELSE 'กระจายใน ' || places_increased || ' ร้าน — เป็นปัญหาภาพรวม' END AS detail,
  category, before, after, delta, pct_change, high_count, spread, places_increased, top_places FROM typed""",
)
def _(t):
    return _flat(snapshots.alerts(snapshots.compare(t, *snapshot_tables(t), 1, 2, min_delta=2)))


def _trend_sql(unit: str, window: str, top: int) -> str:
    rows = f"SELECT CAST(date_trunc('{unit}', r.review_date_approx) AS DATE) AS bucket, ar.pain_point_category AS category, ar.sentiment {BASE} WHERE {HT} AND r.review_date_approx IS NOT NULL AND {window}"
    return f"""
WITH rs AS ({rows}), lead AS (SELECT category FROM rs WHERE sentiment = 'negative' AND category NOT IN {NP} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {top}),
cells AS (SELECT bucket, category, count(*) AS count FROM rs WHERE sentiment = 'negative' AND category IN (SELECT category FROM lead) GROUP BY 1, 2),
whole AS (SELECT bucket, count(*) AS bucket_total, count(*) FILTER (sentiment = 'negative') AS bucket_negative FROM rs GROUP BY 1),
grid AS (SELECT b.bucket, l.category, coalesce(c.count, 0) AS count, coalesce(bucket_total, 0) AS bucket_total, coalesce(bucket_negative, 0) AS bucket_negative
  FROM (SELECT DISTINCT bucket FROM cells) b CROSS JOIN lead l LEFT JOIN cells c ON c.bucket = b.bucket AND c.category = l.category LEFT JOIN whole w ON w.bucket = b.bucket)
SELECT *, CAST(sum(count) OVER (PARTITION BY bucket) AS BIGINT) AS total, {_rate('count', 'bucket_total')} AS rate, {_rate('count', 'bucket_negative')} AS share, {_rate('bucket_negative', 'bucket_total')} AS complaint_rate,
  bucket_total < {domain.LOW_CONFIDENCE_MIN} AS low_confidence, count - lag(count) OVER (PARTITION BY category ORDER BY bucket) AS delta FROM grid"""


AS_OF = star.AS_OF.isoformat()


@over_star("q11_trending_month", _trend_sql("month", f"r.review_date_approx < date_trunc('month', DATE '{AS_OF}') AND r.review_date_approx >= date_trunc('month', DATE '{AS_OF}') - INTERVAL 6 MONTH", 5))
def _(t):
    return insights.trending(t, star.AS_OF)


@over_star("q11_trending_week", _trend_sql("week", f"r.review_date_approx < date_trunc('week', DATE '{AS_OF}') AND r.review_date_approx >= date_trunc('week', DATE '{AS_OF}') - INTERVAL 8 WEEK AND coalesce(p.zone, 'other') = 'other'", 3))
def _(t):
    return insights.trending(t, star.AS_OF, "week", 8, 3, "other")


@over_star("q11_trending_dates", _trend_sql("month", f"r.review_date_approx BETWEEN DATE '1997-02-10' AND DATE '1997-09-20' AND {OPEN}", 5))
def _(t):
    return insights.trending(t, star.AS_OF, date_from="1997-02-10", date_to="1997-09-20", status="operational")


@over_star("q13_category_counts", f"SELECT ar.pain_point_category AS category, count(*) AS count {BASE} WHERE ar.pain_point_category IS NOT NULL AND {HT} GROUP BY 1")
def _(t):
    return insights.category_counts(t)


def _map_sql(how: str, where: str, dates: str = "") -> str:
    return f"""
SELECT p.id, p.name, p.overall_rating AS rating, p.lng, p.lat, mode() WITHIN GROUP (ORDER BY ar.severity) AS dominant_severity,
  coalesce(array_to_string(list_sort(list_distinct(list(ar.pain_point_category) FILTER (ar.pain_point_category IS NOT NULL))), '|'), '') AS pain_categories,
  count(*) FILTER (ar.severity = 'high') AS high_count, count(r.id) AS review_count
FROM places p {how} reviews r ON r.place_id = p.id {dates} LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL {where} GROUP BY 1, 2, 3, 4, 5"""


def _flat_map(df):
    return df.withColumn("pain_categories", F.array_join("pain_categories", "|"))


@over_star("q14_heatmap", _map_sql("LEFT JOIN", ""))
def _(t):
    return _flat_map(insights.place_map(t))


@over_star("q20_map_dates", _map_sql("JOIN", f"AND {OPEN}", "AND r.review_date_approx >= DATE '1999-01-01'"))
def _(t):
    return _flat_map(insights.place_map(t, "operational", "1999-01-01"))


PLACE_COUNTS = "(SELECT r.place_id, count(*) AS review_count, count(*) FILTER (ar.severity = 'high') AS high_severity_count FROM reviews r LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id GROUP BY 1) c"
PLACE_COLUMNS = "p.id, p.name, p.search_query, p.overall_rating, p.scraped_at, p.lng, p.lat, coalesce(c.review_count, 0) AS review_count, coalesce(c.high_severity_count, 0) AS high_severity_count"


@over_star("q15_list_places", f"SELECT {PLACE_COLUMNS} FROM places p LEFT JOIN {PLACE_COUNTS} ON c.place_id = p.id ORDER BY p.name, p.id LIMIT 50 OFFSET 20")
def _(t):
    return places.list_places(t, 50, 20)


@over_star("q15_get_place", f"SELECT {PLACE_COLUMNS} FROM places p LEFT JOIN {PLACE_COUNTS} ON c.place_id = p.id WHERE p.id = 11")
def _(t):
    return places.get_place(t, 11)


HAV = "{r} * 2 * atan2(sqrt(a), sqrt(1 - a))"


def haversine_sql(lat1, lng1, lat2, lng2, radius) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"({radius * 2} * atan2(sqrt({a}), sqrt(1 - {a})))"


REDUCED = "atan((1 - 1 / 298.257223563) * tan(radians({0})))"


@over_star(
    "q16_nearby_places",
    f"""SELECT p.id, p.name, p.overall_rating, p.lng, p.lat, round(d, 3) AS distance_m, coalesce(c.review_count, 0) AS review_count, coalesce(c.high_severity_count, 0) AS high_severity_count
FROM (SELECT *, CASE WHEN s = 0 THEN 0 ELSE 6378137.0 * (s - (x + y) / 298.257223563 / 2) END AS d FROM (SELECT *, (s - sin(s)) * pow(sin((b1 + b2) / 2), 2) * pow(cos((b2 - b1) / 2), 2) / pow(cos(s / 2), 2) AS x, (s + sin(s)) * pow(cos((b1 + b2) / 2), 2) * pow(sin((b2 - b1) / 2), 2) / nullif(pow(sin(s / 2), 2), 0) AS y
  FROM (SELECT *, 2 * atan2(sqrt(h), sqrt(1 - h)) AS s FROM (SELECT *, pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(radians(100.4 - lng) / 2), 2) AS h FROM (SELECT *, {REDUCED.format('lat')} AS b1, {REDUCED.format('16.8')} AS b2 FROM places))))) p LEFT JOIN {PLACE_COUNTS} ON c.place_id = p.id WHERE d <= 30000 ORDER BY d, p.id LIMIT 20""",
)
def _(t):
    return places.nearby(t, 16.8, 100.4, 30000).withColumn("distance_m", F.round("distance_m", 3))


@over_star("q17_place_pain_points", f"SELECT ar.pain_point_category AS category, ar.severity, count(*) AS count FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE r.place_id = 4 AND {HT} GROUP BY 1, 2")
def _(t):
    return places.place_pain_points(t, 4, with_text_only=True)


LISTING = "FROM reviews r JOIN places p ON p.id = r.place_id LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id"
ITEM = "r.id, r.place_id, p.name AS place_name, r.rating, r.text_clean AS text, r.review_date, r.review_date_approx, ar.sentiment, ar.pain_point_category AS category, ar.severity, ar.keywords"


@over_star("q18_review_totals", f"SELECT count(*) FILTER ({HT}) AS total, count(*) FILTER (NOT ({HT})) AS hidden_no_text {LISTING} WHERE {NEG} AND ar.pain_point_category NOT IN {NP} AND {OPEN}")
def _(t):
    return places.review_totals(t, view="complaints", status="operational")


@over_star("q18_list_reviews", f"SELECT {ITEM} {LISTING} WHERE {HT} ORDER BY CASE ar.severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, r.review_date_approx DESC NULLS LAST, r.id DESC LIMIT 50 OFFSET 50")
def _(t):
    return places.list_reviews(t, 2, 50)


@over_star("q19_place_reviews", f"SELECT {ITEM} {LISTING} WHERE r.place_id = 5 ORDER BY r.id DESC LIMIT 20 OFFSET 2")
def _(t):
    return places.place_reviews(t, 5, offset=2)


@over_star(
    "q21_jobs",
    """SELECT * FROM (SELECT place_id % 40 AS id, CASE place_id % 3 WHEN 0 THEN 'discover' ELSE 'refresh' END AS job_type, CASE WHEN place_id % 40 % 7 = 0 THEN 'failed' ELSE 'done' END AS status, max(scraped_at) AS started_at, max(scraped_at) AS finished_at, count(*) AS reviews_count FROM reviews WHERE place_id % 3 = 0 GROUP BY 1, 2, 3)
ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 20""",
)
def _(t):
    log = t.reviews.where("place_id % 3 = 0").selectExpr("place_id % 40 AS id", "CASE place_id % 3 WHEN 0 THEN 'discover' ELSE 'refresh' END AS job_type", "CASE WHEN place_id % 40 % 7 = 0 THEN 'failed' ELSE 'done' END AS status", "scraped_at AS started_at", "scraped_at AS finished_at")
    counted = log.groupBy("id").agg(F.count(F.lit(1)).alias("reviews_count"))
    return places.jobs(log).join(counted, "id")


@over_star("q22_available_months", f"""
SELECT year, month, [{', '.join(f"'{x}'" for x in domain.THAI_MONTHS)}][month] || ' ' || (year + 543) AS label, reviews FROM (SELECT CAST(year(review_date_approx) AS INT) AS year, CAST(month(review_date_approx) AS INT) AS month, count(*) AS reviews FROM reviews r
WHERE {HT} AND review_date_approx < DATE '2001-08-01' GROUP BY 1, 2) WHERE reviews >= 10 ORDER BY year DESC, month DESC LIMIT 24""")
def _(t):
    return report.months_with_data(t, star.AS_OF)


MONTHS = f"""SELECT CAST(date_trunc('month', r.review_date_approx) AS DATE) AS bucket, count(*) FILTER ({HT}) AS reviews, count(*) FILTER ({NEG} AND {HT}) AS complaints, count(*) FILTER (ar.sentiment = 'positive' AND {HT}) AS praise,
  count(*) FILTER ({NEG} AND ar.severity = 'high' AND {HT}) AS high, count(*) FILTER ({NEG} AND ar.severity = 'medium' AND {HT}) AS medium, count(*) FILTER ({NEG} AND ar.severity = 'low' AND {HT}) AS low,
  count(DISTINCT r.place_id) FILTER ({HT}) AS places, count(*) FILTER (NOT ({HT})) AS excluded_no_text {LISTING} WHERE r.review_date_approx >= DATE '1998-05-01' AND r.review_date_approx < DATE '1999-06-01' AND {OPEN} GROUP BY 1"""


@over_star("q23_report_months", MONTHS)
def _(t):
    return report.by_month(t, date(1998, 5, 1), date(1999, 6, 1))


def _report_sql() -> str:
    at = lambda day, n: f"coalesce(CAST(sum(CASE WHEN bucket = DATE '{day}' THEN {n} END) AS BIGINT), 0)"
    cols = [f"{at(d, n)} AS {p}_{n}" for p, d in (("cur", "1999-05-01"), ("prev", "1999-04-01"), ("ly", "1998-05-01")) for n in report.MEASURES]
    cols += [f"coalesce(round_even(avg(CASE WHEN bucket <> DATE '1998-05-01' THEN {n} END), 1), 0) AS avg_{n}" for n in report.MEASURES]
    return f"""WITH months AS ({MONTHS}), one AS (SELECT {', '.join(cols)}, {at('1999-05-01', 'excluded_no_text')} AS excluded_no_text, count(*) FILTER (bucket <> DATE '1998-05-01') AS avg_months, count(*) FILTER (bucket = DATE '1998-05-01') > 0 AS ly_available FROM months)
SELECT *, (SELECT count(*) FROM places p WHERE {OPEN}) AS total_places, cur_complaints - prev_complaints AS complaint_delta, cur_places - prev_places AS places_delta FROM one"""


@over_star("q23_report_summary", _report_sql())
def _(t):
    return report.summary(t, 1999, 5)


IN_MONTH = "r.review_date_approx >= DATE '1999-05-01' AND r.review_date_approx < DATE '1999-06-01'"


@over_star(
    "q23_report_top_problems",
    f"""WITH rs AS (SELECT ar.pain_point_category AS category, ar.severity, r.review_date_approx >= DATE '1999-05-01' AS now {BASE} WHERE {NEG} AND {HT} AND {OPEN} AND r.review_date_approx >= DATE '1999-04-01' AND r.review_date_approx < DATE '1999-06-01')
SELECT category, count(*) FILTER (now) AS count, count(*) FILTER (now AND severity = 'high') AS high, count(*) FILTER (NOT now) AS prev, round_even(count(*) FILTER (now) / (SELECT count(*) FROM rs WHERE now) * 100, 1) AS pct, count(*) FILTER (now) - count(*) FILTER (NOT now) AS delta
FROM rs WHERE category NOT IN {NP} GROUP BY 1 HAVING count(*) FILTER (now) > 0 ORDER BY 2 DESC, 1 LIMIT 8""",
)
def _(t):
    return report.top_problems(t, 1999, 5)


@over_star(
    "q23_report_zones",
    f"""SELECT zone, {LABEL.format('zone', 'zone')} AS label, complaints, praise, coalesce(top_category, '—') AS top_category FROM (SELECT coalesce(p.zone, 'other') AS zone, count(*) FILTER ({NEG}) AS complaints, count(*) FILTER (ar.sentiment = 'positive') AS praise,
  mode() WITHIN GROUP (ORDER BY CASE WHEN {NEG} AND ar.pain_point_category NOT IN {NP} THEN ar.pain_point_category END) AS top_category {BASE} WHERE {HT} AND {IN_MONTH} AND {OPEN} GROUP BY 1)""",
)
def _(t):
    return report.zones(t, 1999, 5)


@over_star(
    "q23_report_worst_places",
    f"""SELECT p.id AS place_id, p.name, coalesce(p.zone, 'other') AS zone, count(*) AS complaints, count(*) FILTER (ar.severity = 'high') AS high,
  coalesce(mode() WITHIN GROUP (ORDER BY CASE WHEN ar.pain_point_category NOT IN {NP} THEN ar.pain_point_category END), '—') AS top_category {BASE} WHERE {NEG} AND {HT} AND {IN_MONTH} AND {OPEN} GROUP BY 1, 2, 3 ORDER BY complaints DESC, high DESC, place_id LIMIT 10""",
)
def _(t):
    return report.worst_places(t, 1999, 5)


@over_star("q23_report_highlights", f"SELECT ar.pain_point_category AS category, count(*) AS count {BASE} WHERE ar.sentiment = 'positive' AND ar.pain_point_category NOT IN {NP} AND {HT} AND {IN_MONTH} AND {OPEN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return report.highlights(t, 1999, 5)


@over_star(
    "q23_report_sample_reviews",
    f"""SELECT place_name, rating, substring(text_clean, 1, 220) AS text, sev_rank FROM (SELECT *, row_number() OVER (PARTITION BY text_clean ORDER BY sev_rank, id) AS n FROM (SELECT r.id, p.name AS place_name, r.rating, r.text_clean, CASE ar.severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sev_rank
{BASE} WHERE {NEG} AND ar.pain_point_category = 'ความปลอดภัย' AND {HT} AND {IN_MONTH})) WHERE n = 1 ORDER BY sev_rank, text_clean LIMIT 5""",
)
def _(t):
    return report.sample_reviews(t, 1999, 5, "ความปลอดภัย")
