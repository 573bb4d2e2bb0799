"""The review domain's tables as views over the driver's data.

Each view is one SELECT that both Spark and DuckDB run, so queries and their SQL see
the same rows: places from customers, reviews and labels from orders, place candidates
from parts and search cells from suppliers.  Every row of those tables is read.  So that
places without reviews exist, every 13th customer's orders name a place that is not there;
reviews whose text has not been cleaned yet (a null) have no label yet either.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from tallyloom.functions import domain
from tallyloom.tables import Tables

#: The day that stands for now.
AS_OF = date(2001, 8, 2)

CATEGORY_CASE = "CASE r.id * 7 % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(domain.CATEGORY_KEYS)) + " END"

PLACES = """
SELECT c.c_custkey AS id, c.c_name AS name,
       CASE WHEN c.c_custkey % 4 = 0 THEN '' WHEN c.c_custkey % 4 = 1 THEN c.c_name ELSE concat('q ', c.c_name) END AS search_query,
       CASE r.r_name WHEN 'AFRICA' THEN 'naresuan' WHEN 'AMERICA' THEN 'rajabhat' WHEN 'ASIA' THEN 'city_center' WHEN 'EUROPE' THEN 'other' END AS zone,
       CASE c.c_custkey % 8 WHEN 0 THEN 'Cafe' WHEN 1 THEN 'thai restaurant' WHEN 2 THEN NULL WHEN 3 THEN 'national park office' WHEN 4 THEN 'เพิ่มเว็บไซต์' WHEN 5 THEN '' ELSE c.c_mktsegment END AS google_category,
       CASE c.c_custkey % 10 WHEN 0 THEN 'closed_permanently' WHEN 1 THEN 'closed_temporarily' WHEN 2 THEN NULL ELSE 'operational' END AS business_status,
       CASE WHEN c.c_custkey % 31 = 0 THEN NULL ELSE 16.35E0 + CAST(c.c_custkey * 37 % 1000 AS DOUBLE) / 1000E0 END AS lat,
       CASE WHEN c.c_custkey % 31 = 0 THEN NULL ELSE 100.05E0 + CAST(c.c_custkey * 61 % 1150 AS DOUBLE) / 1000E0 END AS lng,
       CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey * 7 % 41 + 10 AS DOUBLE) / 10E0 END AS overall_rating,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(c.c_custkey * 13 % 1200 AS INT) END AS google_reviews_total,
       CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE DATE '2001-08-02' - CAST(c.c_custkey % 45 AS INT) END AS scraped_at,
       CASE WHEN c.c_custkey % 9 < 5 THEN NULL ELSE DATE '2001-08-02' - CAST(c.c_custkey % 90 AS INT) END AS deep_scanned_at,
       CAST(c.c_custkey % 5 AS INT) AS consecutive_no_change, CAST(c.c_custkey % 4 AS INT) AS deep_attempts,
       CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE CAST(c.c_custkey % 5 AS INT) END AS refresh_shortfalls,
       CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE concat('gp', CAST(c.c_custkey AS STRING)) END AS google_place_id,
       CASE c.c_custkey % 6 WHEN 0 THEN 'lodging,point_of_interest' WHEN 1 THEN 'restaurant,food' WHEN 2 THEN 'locality,political' WHEN 3 THEN 'cafe,lodging' WHEN 4 THEN 'store,museum' END AS google_types,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'scrape' ELSE 'api' END AS discovered_by,
       c.c_custkey % 17 = 0 AS scrape_excluded,
       CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE CAST(c.c_custkey * 3 % 20 AS INT) END AS last_review_count
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

REVIEWS = """
SELECT o_orderkey AS id, CASE WHEN o_custkey % 13 = 0 THEN -o_custkey ELSE o_custkey END AS place_id, CAST(substring(o_orderpriority, 1, 1) AS INT) AS rating,
       CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN NULL
            ELSE concat('review text ', CAST(o_orderkey % 997 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' with some more words, so that it is long' ELSE '' END) END AS text_clean,
       concat('Name ', CAST(o_orderkey % 89 AS STRING), chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'Local Guide' ELSE '5 รีวิว · 118 รูปภาพ' END, chr(10),
              CAST(o_orderkey % 11 + 1 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN ' เดือนที่แล้ว' WHEN 1 THEN ' weeks ago' WHEN 2 THEN ' ปีที่แล้ว' ELSE ' วันที่แล้ว' END,
              CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(chr(10), 'review text ', CAST(o_orderkey % 997 AS STRING)) END,
              chr(10), 'ชอบ', chr(10), CASE WHEN o_orderkey % 7 = 0 THEN 'คำตอบจากเจ้าของ ขอบคุณ' ELSE 'แชร์' END) AS text,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'a week ago' ELSE '๓ เดือนที่ผ่านมา' END AS review_date,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS review_date_approx,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 3 AS INT) AS scraped_at
FROM {orders}
"""

ANALYZED = f"""
SELECT r.id AS id, r.id AS review_id,
       CASE WHEN r.id % 29 = 0 THEN NULL WHEN r.rating >= 4 THEN 'positive' WHEN r.rating = 3 THEN 'neutral' ELSE 'negative' END AS sentiment,
       CASE WHEN r.id % 37 = 0 THEN NULL ELSE {CATEGORY_CASE} END AS pain_point_category,
       CASE WHEN r.rating = 1 THEN 'high' WHEN r.rating = 2 AND r.id % 4 <> 0 THEN 'medium' WHEN r.id % 41 = 0 THEN NULL ELSE 'low' END AS severity,
       concat('word', CAST(r.id % 7 AS STRING), '|text') AS keywords,
       CASE WHEN r.id % 3 = 0 THEN 'claude-haiku-4-5' WHEN r.id % 3 = 1 THEN 'claude-haiku-4-5-full' ELSE 'rules' END AS model_used
FROM {{reviews}} r WHERE r.text_clean IS NOT NULL
"""

CANDIDATES = """
SELECT concat('gp', CAST(p_partkey * 2 AS STRING)) AS google_place_id,
       CASE WHEN p_partkey % 12 = 0 THEN concat('Customer#', lpad(CAST(p_partkey AS STRING), 9, '0')) ELSE p_name END AS name,
       16.35E0 + CAST(p_partkey * 37 % 1000 AS DOUBLE) / 1000E0 + CASE p_partkey % 5 WHEN 0 THEN 0E0 WHEN 1 THEN 0.0002E0 ELSE 0.003E0 END AS lat,
       100.05E0 + CAST(p_partkey * 61 % 1150 AS DOUBLE) / 1000E0 AS lng,
       CASE p_partkey % 5 WHEN 0 THEN 'restaurant,food' WHEN 1 THEN 'cafe' WHEN 2 THEN 'lodging' WHEN 3 THEN 'museum,point_of_interest' ELSE NULL END AS google_types,
       CAST(p_partkey * 11 % 400 AS INT) AS google_reviews_total,
       CASE p_partkey % 4 WHEN 0 THEN 'existing' WHEN 3 THEN 'reject' ELSE 'new' END AS decision,
       CASE p_partkey % 4 WHEN 0 THEN 'naresuan' WHEN 1 THEN 'rajabhat' WHEN 2 THEN 'city_center' END AS nearest_zone,
       CAST(p_partkey * 17 % 6000 AS DOUBLE) / 1000E0 AS dist_km,
       CASE p_partkey % 3 WHEN 0 THEN 'cafe' WHEN 1 THEN 'museum' ELSE 'place_of_worship' END AS source_type,
       CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS matched_place_id,
       CASE WHEN p_partkey % 3 = 0 THEN concat('addr ', CAST(p_partkey AS STRING)) END AS formatted_address,
       CASE WHEN p_partkey % 5 = 0 THEN 'ทุกวัน' END AS opening_hours
FROM {part}
"""

CELLS = """
SELECT 16.5E0 + CAST(s_suppkey % 10 AS DOUBLE) / 100E0 AS cell_lat, 100.2E0 + CAST(s_suppkey % 7 AS DOUBLE) / 100E0 AS cell_lng,
       CASE s_suppkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 500 ELSE 100 END AS cell_radius_m,
       CASE s_suppkey % 4 WHEN 0 THEN 'cafe' WHEN 1 THEN 'museum' WHEN 2 THEN 'place_of_worship' ELSE 'bakery' END AS place_type,
       CAST(s_suppkey % 3 + 1 AS INT) AS pages, CAST(s_suppkey * 7 % 61 AS INT) AS results, s_suppkey * 7 % 61 >= 40 AS hit_cap,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(floor(s_suppkey * 7 % 61 * (s_suppkey % 4) / 4) AS INT) END AS type_matched,
       CASE WHEN s_suppkey % 9 = 0 THEN 'ERROR' ELSE 'OK' END AS status
FROM {supplier}
"""

SOURCES = ("customer", "nation", "region", "orders", "part", "supplier")


def _views() -> dict[str, str]:
    plain = {name: name for name in SOURCES}
    return {
        "places": PLACES.format(**plain),
        "reviews": REVIEWS.format(**plain),
        "analyzed_reviews": ANALYZED.format(reviews="reviews"),
        "place_candidates": CANDIDATES.format(**plain),
        "discover_cells": CELLS.format(**plain),
    }


def sql(query: str) -> str:
    """DuckDB SQL over the views: those that the query names are put before it."""
    views = {name: body.replace("AS STRING", "AS VARCHAR") for name, body in _views().items()}
    wanted = [n for n in views if n in query]
    if "analyzed_reviews" in wanted and "reviews" not in wanted:
        wanted.append("reviews")
    ctes = [f"{n} AS ({views[n]})" for n in views if n in wanted]
    query = query.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(head):
            return head + ",\n".join(ctes) + ",\n" + query.removeprefix(head)
    return "WITH " + ",\n".join(ctes) + "\n" + query


def load(spark: SparkSession, sf_dir: str) -> Tables:
    raw = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}
    reviews = spark.sql(REVIEWS, orders=raw["orders"])
    return Tables(
        places=spark.sql(PLACES, customer=raw["customer"], nation=raw["nation"], region=raw["region"]),
        reviews=reviews,
        analyzed=spark.sql(ANALYZED, reviews=reviews),
        candidates=spark.sql(CANDIDATES, part=raw["part"]),
        cells=spark.sql(CELLS, supplier=raw["supplier"]),
    )
