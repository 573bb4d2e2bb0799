"""Text, date and label functions, evaluation and event windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import dates, domain, filters as f, measures as m, text as x
from tallyloom.operators import evaluate
from tallyloom.plans import star
from tallyloom.plans.insight_queries import HT
from tallyloom.plans.registry import over_files, over_star
from tallyloom.streaming import ingest, windows

# The raw text of a review is made of known lines, so what must be left of it can be told from its id.
BODY = "CASE WHEN id % 5 = 0 THEN '' ELSE concat('review text ', CAST(id % 997 AS VARCHAR)) END"


@over_star("x01_clean_review_text", f"SELECT id, {BODY} AS text FROM reviews")
def _(t):
    return t.reviews.select("id", x.clean_review_text(F.col("text")).alias("text"))


@over_star("x02_rating_only", "SELECT id, id % 5 = 0 AS rating_only FROM reviews")
def _(t):
    return t.reviews.select("id", x.is_rating_only(F.col("text")).alias("rating_only"))


@over_star("x03_text_hash", f"SELECT id, md5(CASE WHEN id % 5 = 0 THEN text ELSE {BODY} END) AS text_hash FROM reviews")
def _(t):
    return t.reviews.select("id", x.review_text_hash(F.col("text")).alias("text_hash"))


@over_star(
    "x05_relative_date",
    """SELECT id, CASE id % 4 WHEN 0 THEN DATE '2001-08-02' - CAST((id % 11 + 1) * 30 AS INT) WHEN 1 THEN CASE WHEN id % 11 + 1 <= 8 THEN DATE '2001-08-02' - CAST((id % 11 + 1) * 7 AS INT) END WHEN 2 THEN DATE '2001-08-02' - CAST((id % 11 + 1) * 365 AS INT) ELSE DATE '2001-08-02' - CAST(id % 11 + 1 AS INT) END AS day FROM reviews""",
)
def _(t):
    return t.reviews.select("id", dates.relative_date(dates.relative_phrase(F.col("text")), F.lit(star.AS_OF)).alias("day"))


@over_files("x13_clean_noise", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, 'http\S+|www\.\S+|<[^>]+>|[^\x{0E00}-\x{0E7F}\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def _(spark, table):
    return table("documents").select("doc_id", F.md5(x.clean_noise(F.col("text"))).alias("h"))


@over_files("x14_keywords", r"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, 'http\S+|www\.\S+|<[^>]+>|[^\x{0E00}-\x{0E7F}\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN ('the', 'and', 'de'))[1:10], ' ') AS keywords FROM documents")
def _(spark, table):
    return table("documents").select("doc_id", F.array_join(x.keywords(F.col("text"), ("the", "and", "de")), " ").alias("keywords"))


@over_star(
    "x15_rule_categories",
    "SELECT id, CASE WHEN google_category = 'เพิ่มเว็บไซต์' THEN 'อื่นๆ' WHEN id % 3 = 0 THEN 'การเดินทางและที่จอดรถ|ราคาและความคุ้มค่า' WHEN id % 3 = 1 THEN 'การบริการและเจ้าหน้าที่' ELSE 'ความสะอาดและสิ่งแวดล้อม' END AS categories FROM places",
)
def _(t):
    said = F.when(F.col("google_category") == "เพิ่มเว็บไซต์", "xyz").when(F.col("id") % 3 == 0, "ราคาแพง จอดรถยาก").when(F.col("id") % 3 == 1, "พนักงานดี").otherwise("ห้องน้ำเหม็น")
    return t.places.select("id", F.array_join(x.rule_categories(said), "|").alias("categories"))


@over_star(
    "x16_rules_by_rating",
    "SELECT rating, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN rating IS NULL OR rating = 2 THEN 'medium' WHEN rating = 1 THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM (SELECT nullif(rating, 3) AS rating FROM reviews) GROUP BY 1, 2, 3",
)
def _(t):
    r = t.reviews.select(F.nullif("rating", F.lit(3)).alias("rating"))
    return r.groupBy("rating", x.sentiment_from_rating(F.col("rating")).alias("sentiment"), x.severity_from_rating(F.col("rating")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@over_star(
    "x16_severity_gate",
    f"""SELECT gated, count(*) AS n FROM (SELECT CASE WHEN ar.sentiment = 'negative' AND coalesce(ar.pain_point_category, '') NOT IN ('{"', '".join(domain.NON_PROBLEM)}') THEN CASE WHEN r.rating = 1 THEN 'high' WHEN r.rating = 2 THEN 'medium' ELSE 'low' END ELSE 'low' END AS gated FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id) GROUP BY 1""",
)
def _(t):
    return t.labelled().groupBy(x.severity_gate(F.col("sentiment"), F.col("pain_point_category"), F.col("rating")).alias("gated")).agg(F.count(F.lit(1)).alias("n"))


@over_files("x17_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END AS short FROM documents")
def _(spark, table):
    return table("documents").select("doc_id", x.ellipsis(F.col("text")).alias("short"))


@over_star("x18_week_buckets", "SELECT CAST(date_trunc('week', review_date_approx) AS DATE) AS week, CAST(date_trunc('month', review_date_approx) AS DATE) AS month, count(*) AS n FROM reviews WHERE review_date_approx IS NOT NULL GROUP BY 1, 2")
def _(t):
    day = F.col("review_date_approx")
    return t.reviews.where(day.isNotNull()).groupBy(dates.bucket(day, "week").alias("week"), dates.bucket(day, "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@over_star("x22_rate_labels", f"SELECT place_id, CASE WHEN b > 0 THEN format('{{:.1f}}% ({{}}/{{}})', CAST(a AS DOUBLE) * 100 / b, a, b) ELSE '—' END AS label FROM (SELECT r.place_id, count(*) FILTER (ar.sentiment = 'negative' AND {HT}) AS a, count(*) FILTER ({HT}) AS b FROM reviews r JOIN analyzed_reviews ar ON ar.review_id = r.id GROUP BY 1)")
def _(t):
    rows = t.labelled().groupBy("place_id").agg(m.n_if(m.negative() & f.has_text()).alias("a"), m.n_if(f.has_text()).alias("b"))
    return rows.select("place_id", m.percent_label(F.col("a"), F.col("b")).alias("label"))


@over_star("x24_weekly_hours", "SELECT id, CASE id % 3 WHEN 0 THEN 'ทุกวัน 6:00-20:00' WHEN 1 THEN 'จ 8:00-17:00 | ส 9:30-14:30, 17:00-2:30 | อา ปิด' END AS hours FROM places")
def _(t):
    every = F.transform(F.array(*(F.lit(d) for d in x.DAYS)), lambda d: F.concat(d, F.lit(" 6:00–20:00")))
    some = F.array(F.lit("วันอาทิตย์ ปิดทำการ"), F.lit("วันจันทร์ 8:00 ถึง 17:00"), F.lit("วันเสาร์ 9:30-14:30 17:00-2:30"), F.lit("รูปภาพ วันศุกร์ 1:00-2:00"))
    rows = F.when(F.col("id") % 3 == 0, every).when(F.col("id") % 3 == 1, some).otherwise(F.array(F.lit("none")))
    return t.places.select("id", x.weekly_hours(rows).alias("hours"))


@over_star("x25_coordinates_of_url", "SELECT id, CASE WHEN id % 4 = 0 OR id % 4 = 1 AND id % 3 > 0 OR id % 4 = 3 THEN CAST(16.5 AS DOUBLE) END AS lat, CASE WHEN id % 4 = 0 OR id % 4 = 1 AND id % 3 > 0 OR id % 4 = 3 THEN CAST(100.25 AS DOUBLE) END AS lng FROM places")
def _(t):
    url = F.when(F.col("id") % 4 == 0, "https://x/@1.0,2.0,9z/data=!3d16.5!4d100.25").when(F.col("id") % 4 == 1, F.concat(F.lit("https://x/@16.5,100.25,"), (F.col("id") % 3 + 14).cast("string"), F.lit("z"))).when(F.col("id") % 4 == 2, "https://x/none").otherwise("https://x/@16.5,100.25")
    at = x.coordinates_of_url(url)
    return t.places.select("id", at["lat"].alias("lat"), at["lng"].alias("lng"))


@over_star("x27_parse_rating", "SELECT id, overall_rating AS rating FROM places")
def _(t):
    return t.places.select("id", x.parse_rating(F.replace(F.col("overall_rating").cast("string"), F.lit("."), F.lit(","))).alias("rating"))


@over_star("x33_query_term", "SELECT id, CASE WHEN id % 4 = 0 THEN name WHEN id % 4 = 1 THEN search_query ELSE name END AS term FROM places")
def _(t):
    return t.places.select("id", x.query_term(F.col("name"), F.col("search_query")).alias("term"))


@over_files("x28_parse_labels", "SELECT doc_id AS id, CASE doc_id % 2 WHEN 0 THEN 'ความปลอดภัย' ELSE 'อื่นๆ' END AS category, 'negative' AS sentiment FROM documents WHERE doc_id % 10 < 2 AND doc_id % 20 <> 1")
def _(spark, table):
    docs = table("documents").select(F.col("doc_id").alias("id"))
    known = F.when(F.col("id") % 20 == 1, "unknown").when(F.col("id") % 2 == 0, "ความปลอดภัย").otherwise("อื่นๆ")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("id", known.alias("category"), F.lit("negative").alias("sentiment")))), F.lit("\n```"))
    return x.parse_labels(docs.select(answer.alias("answer")), "answer", docs.where("id % 10 < 2"))


@over_star("j05_unlabelled", "SELECT r.id, r.place_id FROM reviews r LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE ar.id IS NULL")
def _(t):
    return ingest.unlabelled(t.reviews, t.analyzed).select("id", "place_id")


@over_star("t02_label_new", "SELECT r.id AS review_id, CASE WHEN r.rating >= 4 THEN 'positive' WHEN r.rating <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN coalesce(r.text_clean, '') <> '' THEN 'อื่นๆ' END AS category FROM reviews r LEFT JOIN analyzed_reviews ar ON ar.review_id = r.id WHERE ar.id IS NULL")
def _(t):
    return ingest.label_new(t.reviews, t.analyzed).select("review_id", "sentiment", F.col("pain_point_category").alias("category"))


def _gold(table):
    return table("labels").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"))


CELLS = "c AS (SELECT CAST(quality AS VARCHAR) AS gold, CAST(toxic AS VARCHAR) AS pred, count(*) AS n FROM labels GROUP BY 1, 2)"
CLASSES = f"""{CELLS}, k AS (SELECT DISTINCT gold AS class FROM c UNION SELECT DISTINCT pred FROM c),
pc AS (SELECT class, CAST(coalesce((SELECT sum(n) FROM c WHERE gold = class), 0) AS BIGINT) AS support, CAST(coalesce((SELECT sum(n) FROM c WHERE gold = class AND pred = class), 0) AS BIGINT) AS hit, CAST(coalesce((SELECT sum(n) FROM c WHERE pred = class), 0) AS BIGINT) AS predicted FROM k),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(hit AS DOUBLE) / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN CAST(hit AS DOUBLE) / support ELSE 0 END AS recall FROM pc),
f1s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


@over_files("e01_per_class", f"WITH {CLASSES} SELECT * FROM f1s")
def _(spark, table):
    return evaluate.per_class(evaluate.confusion(_gold(table)))


@over_files("e01_overall", f"WITH {CLASSES} SELECT sum(hit) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM f1s")
def _(spark, table):
    return evaluate.overall(evaluate.confusion(_gold(table)))


@over_files("e02_confusion_matrix", f"WITH {CELLS} SELECT gold, CAST(coalesce(sum(n) FILTER (pred = '0'), 0) AS BIGINT) AS \"0\", CAST(coalesce(sum(n) FILTER (pred = '1'), 0) AS BIGINT) AS \"1\" FROM c GROUP BY 1")
def _(spark, table):
    return evaluate.confusion_matrix(_gold(table), ["0", "1"])


@over_files("e02_confused", f"WITH {CELLS} SELECT * FROM c WHERE gold <> pred")
def _(spark, table):
    return evaluate.confused(_gold(table))


@over_files(
    "e03_agreement",
    f"""WITH {CELLS}, w AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (gold = pred) AS BIGINT) AS agree, (SELECT sum(CAST(a.n AS DOUBLE) * b.n) FROM (SELECT gold, sum(n) AS n FROM c GROUP BY 1) a JOIN (SELECT pred, sum(n) AS n FROM c GROUP BY 1) b ON a.gold = b.pred) AS chance FROM c)
SELECT n, agree, kappa, CASE WHEN kappa < 0 THEN 'worse than chance' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'good' ELSE 'very good' END AS word FROM (SELECT n, agree, (agree / n - chance / (CAST(n AS DOUBLE) * n)) / (1 - chance / (CAST(n AS DOUBLE) * n)) AS kappa FROM w)""",
)
def _(spark, table):
    return evaluate.agreement(evaluate.confusion(_gold(table)))


TRAIN = f"tr AS (SELECT r.id, ar.pain_point_category AS label, r.text_clean AS text FROM analyzed_reviews ar JOIN reviews r ON r.id = ar.review_id WHERE ar.model_used IN ('claude-haiku-4-5', 'claude-haiku-4-5-full') AND {HT} AND length(r.text_clean) >= 10 AND ar.pain_point_category IS NOT NULL)"


@over_star("e04_clean_labels", f"WITH {TRAIN}, n AS (SELECT label, count(*) AS c FROM tr GROUP BY 1) SELECT CASE WHEN c < 650 THEN 'อื่นๆ' ELSE label END AS label, CAST(sum(c) AS BIGINT) AS n FROM n GROUP BY 1")
def _(t):
    return evaluate.clean_labels(evaluate.training_rows(t), least=650).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@over_star("e05_split_sizes", f"WITH {TRAIN}, n AS (SELECT label, count(*) AS c, greatest(1, CAST(floor(count(*) * 0.15) AS BIGINT)) AS p FROM tr GROUP BY 1) SELECT label, 'test' AS split, p AS n FROM n UNION ALL SELECT label, 'val', p FROM n UNION ALL SELECT label, 'train', c - 2 * p FROM n")
def _(t):
    return evaluate.split(evaluate.training_rows(t)).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@over_star("e06_class_weights", f"WITH {TRAIN}, n AS (SELECT label, count(*) AS n FROM tr GROUP BY 1) SELECT label, n, 1 / sqrt(n) / (SELECT avg(1 / sqrt(n)) FROM n) AS weight FROM n")
def _(t):
    return evaluate.class_weights(evaluate.training_rows(t))


@over_star("e06_quota_sizes", f"WITH {TRAIN} SELECT label, least(count(*), 100) AS n FROM tr GROUP BY 1")
def _(t):
    return evaluate.quota_sample(evaluate.training_rows(t), 100).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@over_files(
    "e07_leakage",
    """WITH s AS (SELECT trim(text) AS text, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM documents WHERE source <> 'src1') SELECT d.doc_id, array_to_string(list_sort(list_distinct(list(s.split))), '+') AS splits, bool_or(s.split IN ('train', 'val')) AS leaked FROM documents d JOIN s ON trim(d.text) = s.text WHERE d.source = 'src1' GROUP BY 1""",
)
def _(spark, table):
    docs = table("documents")
    splits = docs.where("source <> 'src1'").selectExpr("text", "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' ELSE 'train' END AS split")
    return evaluate.leakage(docs.where("source = 'src1'").select("doc_id", "text"), splits).select("doc_id", "splits", "leaked")


@over_files("t09_weekly_events", "SELECT date_trunc('week', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, table):
    return windows.tumbling(table("events"), "event_type").select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "event_type", "n", "total")


@over_files(
    "t09_sliding_events",
    "SELECT s AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([date_trunc('day', ts) - INTERVAL (k) DAY FOR k IN [0, 1, 2, 3, 4, 5, 6]]) AS s FROM events) GROUP BY 1",
)
def _(spark, table):
    return windows.sliding(table("events")).select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "n", "total")


@over_files(
    "t09_session_events",
    """WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, table):
    return windows.sessions(table("events"), "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
