"""Golden rows and Python twins of the scalar functions."""

from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import dates, filters, geo, measures, text as x

REF = date(2026, 1, 31)


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("phrase", "day"),
    [
        ("3 เดือนที่แล้ว", date(2025, 11, 2)),
        ("a week ago", date(2026, 1, 24)),
        ("เมื่อวานนี้", date(2026, 1, 30)),
        ("2 ปีที่แล้ว", date(2024, 2, 1)),
        ("อายุ 93 ปี", None),
        ("99 สัปดาห์ที่แล้ว", None),
        ("5 ชั่วโมงที่แล้ว", None),
        ("๓ เดือนที่ผ่านมา", date(2025, 11, 2)),
        ("Today", REF),
        ("99999999999 days ago", None),
        ("", None),
        (None, None),
    ],
)
def test_relative_date(spark, phrase, day):
    assert one(spark, phrase, lambda c: dates.relative_date(c, F.lit(REF))) == day


def test_relative_phrase(spark):
    assert one(spark, "ดีมาก 2 Weeks AGO จ้า", dates.relative_phrase) == "2 Weeks AGO"
    assert one(spark, "nothing", dates.relative_phrase) is None


@pytest.mark.parametrize(("rating", "severity", "feeling"), [(None, "medium", "neutral"), (1, "high", "negative"), (2, "medium", "negative"), (3, "low", "neutral"), (4, "low", "positive"), (5, "low", "positive")])
def test_by_rating(spark, rating, severity, feeling):
    assert one(spark, rating, x.severity_from_rating, "int") == severity
    assert one(spark, rating, x.sentiment_from_rating, "int") == feeling


def test_rates(spark):
    for n, d, want in ((3, 0, None), (None, 4, 0.0), (1, 4, 0.25), (1, None, None)):
        df = spark.createDataFrame([(n, d)], "n int, d int")
        assert df.select(measures.rate(F.col("n"), F.col("d"))).first()[0] == want


def test_clean_review_text(spark):
    raw = "สมชาย\nLocal Guide · 12 รีวิว\n 4 เดือนที่แล้ว\nอาหารอร่อย   มาก\nบริการ: 5\n+3\nชอบ\nแชร์\nคำตอบจากเจ้าของ 1 วันที่แล้ว\nขอบคุณ"
    assert one(spark, raw, x.clean_review_text) == "อาหารอร่อย มาก"
    assert one(spark, "ดี … เพิ่มเติม", x.clean_review_text) == "ดี"
    assert one(spark, None, x.clean_review_text) == ""


def test_same_hash_under_another_date(spark):
    a = one(spark, "Name\n4 เดือนที่แล้ว\nดีมาก", x.review_text_hash)
    b = one(spark, "Name\n5 เดือนที่แล้ว\nดีมาก", x.review_text_hash)
    assert a == b and len(a) == 32
    assert len(one(spark, "", x.review_text_hash)) == 32
    assert a != one(spark, "Name\n5 เดือนที่แล้ว\nแย่มาก", x.review_text_hash)


def test_rating_only(spark):
    assert one(spark, "ชื่อ\n8 เดือนที่แล้ว", x.is_rating_only)
    assert one(spark, "ชื่อ\n8 เดือนที่แล้ว\nราคาต่อคน\n฿200-300…\nคำตอบจากเจ้าของ\nขอบคุณ", x.is_rating_only)
    assert not one(spark, "ชื่อ\n8 เดือนที่แล้ว\nอร่อย", x.is_rating_only)
    assert not one(spark, "ชื่อ\nอร่อย", x.is_rating_only)
    assert not one(spark, "คำตอบจากเจ้าของ\n8 เดือนที่แล้ว", x.is_rating_only)


def test_rule_categories(spark):
    assert one(spark, "xyz", x.rule_categories) == ["อื่นๆ"]
    assert one(spark, "ราคาแพง ห้องน้ำสกปรก", x.rule_categories) == ["ความสะอาดและสิ่งแวดล้อม", "ราคาและความคุ้มค่า"]


def test_zone_and_box(spark):
    at = lambda lat, lng, build: spark.createDataFrame([(lat, lng)], "lat double, lng double").select(build(F.col("lat"), F.col("lng"))).first()[0]
    assert at(16.7442, 100.1956, geo.assign_zone) == "naresuan"
    assert at(None, None, geo.assign_zone) == "other"
    assert at(17.3, 101.0, geo.assign_zone) == "other"
    assert at(None, 1.0, geo.in_province) is True
    assert at(16.8, 99.9, geo.in_province) is False


def test_lattice_has_no_holes(spark):
    cells = geo.hex_lattice(spark, [(16.8, 100.2), (16.83, 100.25)], 2.0, 1.0)
    points = spark.range(400).selectExpr("16.8D + 0.017D * sin(id) * sqrt(id / 400) AS lat", "100.2D + 0.017D * cos(id) * sqrt(id / 400) AS lng")
    assert geo.covered(points, cells, 1.001).where("NOT covered").count() == 0


def test_dates_that_are_none():
    assert filters.parse_iso("2026-13-01") is None
    assert filters.in_period("2026-13-01", "x") is None
    assert dates.month_range(2025, 12) == (date(2025, 12, 1), date(2026, 1, 1))
    assert dates.whole_month(2024, 2) == ("2024-02-01", "2024-02-29")
    assert dates.last_months(date(2024, 3, 31), 1) == ("2024-02-29", "2024-03-31")


def test_odd_status_is_operational(spark):
    df = spark.createDataFrame([("operational",), (None,), ("closed_permanently",)], "business_status string")
    assert df.where(filters.status_is("foo")).count() == 2
    assert df.where(filters.status_is("closed")).count() == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n…ชอบ1:ago", max_size=30), min_size=1, max_size=8))
def test_cleaning_twice_changes_nothing_in_plain_lines(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for r in df.select(x.clean_review_text(F.col("v")).alias("r")).collect():
        assert r["r"] == r["r"].strip() and "\n" not in r["r"] and "  " not in r["r"]


def test_distance_on_the_spheroid(spark):
    """One degree of latitude and of longitude at the equator, and a known line (Flinders Peak to Buninyong, 54,972.271 m on GRS 80)."""
    lines = [(0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (-37.95103341, 144.42486789, -37.65282114, 143.92649552), (5.0, 5.0, 5.0, 5.0)]
    got = [r["d"] for r in spark.createDataFrame(lines, "a double, b double, c double, e double").select(geo.geodesic(*(F.col(x) for x in "abce")).alias("d")).collect()]
    assert abs(got[0] - 110574.39) < 1 and abs(got[1] - 111319.49) < 1 and abs(got[2] - 54972.27) < 1 and got[3] == 0


def test_date_presets():
    assert dates.last_days(date(2024, 3, 1), 2) == ("2024-02-29", "2024-03-01")
    assert dates.whole_year(2024) == ("2024-01-01", "2024-12-31")


def test_hash_cleans_a_text_once(spark):
    rows = spark.createDataFrame([("a text",)], "text string").select(x.review_text_hash(F.col("text")).alias("h"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Response from the owner") == 1
