"""Distances, zones and hexagonal lattices as Columns.

``haversine`` is on a sphere, ``geodesic`` on the WGS 84 spheroid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import domain

KM, M = 6371.0, 6_371_000.0
KM_PER_LAT, KM_PER_LNG = 110.574, 111.320


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = KM) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), F.lit(2.0))
    return F.lit(radius * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


#: WGS 84 (fixed values): equatorial radius in metres and flattening.
EQUATOR, FLATTENING = 6_378_137.0, 1 / 298.257223563


def geodesic(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on the spheroid by Lambert's formula: reduced latitudes on a sphere, and a flattening term.

    Within a metre at distances inside a province; 0 for one point.
    """
    reduced = lambda lat: F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat)))
    b1, b2 = reduced(lat1), reduced(lat2)
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    a = half(b2 - b1) + F.cos(b1) * F.cos(b2) * half(F.radians(lng2 - lng1))
    angle = 2 * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
    square = lambda x: F.pow(x, F.lit(2.0))
    mid, apart = (b1 + b2) / 2, (b2 - b1) / 2
    x = (angle - F.sin(angle)) * square(F.sin(mid)) * square(F.cos(apart)) / square(F.cos(angle / 2))
    y = (angle + F.sin(angle)) * square(F.cos(mid)) * square(F.sin(apart)) / square(F.sin(angle / 2))
    return F.when(a == 0, 0.0).otherwise(F.lit(EQUATOR) * (angle - F.lit(FLATTENING / 2) * (x + y)))


def zone_distances(lat: Column, lng: Column) -> Column:
    """Array of (distance, zone) structs, nearest first."""
    return F.array_sort(F.array(*(F.struct(haversine(lat, lng, F.lit(a), F.lit(b)).alias("d"), F.lit(z).alias("zone")) for z, (a, b, _) in domain.ZONES.items())))


def assign_zone(lat: Column, lng: Column) -> Column:
    """The nearest zone whose radius reaches the point; else, or without coordinates, other."""
    near = F.filter(zone_distances(lat, lng), lambda x: x["d"] <= F.lit(2.0))
    return F.when(lat.isNull() | lng.isNull(), "other").otherwise(F.coalesce(F.get(near, 0)["zone"], F.lit("other")))


def nearest_zone(lat: Column, lng: Column) -> Column:
    """The nearest zone, however far, as (d, zone)."""
    return F.get(zone_distances(lat, lng), 0)


def campus_distances(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Kilometres to the two campuses, three digits; null without coordinates."""
    return tuple(F.round(haversine(lat, lng, F.lit(domain.ZONES[z][0]), F.lit(domain.ZONES[z][1])), 3) for z in ("naresuan", "rajabhat"))


def in_province(lat: Column, lng: Column) -> Column:
    """Within the bounding box; a missing coordinate passes."""
    a, b, c, d = domain.BBOX
    return lat.isNull() | lng.isNull() | (lat.between(a, b) & lng.between(c, d))


def cell_key(lat: Column, lng: Column, radius_m: Column) -> Column:
    return F.format_string("%.5f,%.5f,%d", lat, lng, radius_m)


def lattice(circles: DataFrame, by: list[str]) -> DataFrame:
    """Hexagonal cells over circles (lat, lng, area_km, cell_km), one lattice for each group ``by``: its columns, lat, lng.

    A group's lattice has its origin in the middle of its distinct centres, and one area_km
    and cell_km.  Every circle makes the cells that reach it, so nothing is compared with all circles.
    Centres are averaged as decimals: cells that just touch a circle stay or go by the last digit of
    the origin, which sums of doubles give differently in every order.
    """
    circles = circles.where("cell_km > 0").dropDuplicates([*by, "lat", "lng"])
    middle = lambda c: F.avg(F.col(c).cast("decimal(20,17)")).cast("double")
    origin = circles.groupBy(*by).agg(middle("lat").alias("lat0"), middle("lng").alias("lng0"))
    step, row = F.col("cell_km") * math.sqrt(3), F.col("cell_km") * 1.5
    reach = F.col("area_km") + F.col("cell_km")
    at = circles.join(origin, by).withColumn("km_lng", KM_PER_LNG * F.cos(F.radians("lat0")))
    at = at.withColumns({"x": (F.col("lng") - F.col("lng0")) * F.col("km_lng"), "y": (F.col("lat") - F.col("lat0")) * KM_PER_LAT})
    rows = at.withColumn("i", F.explode(F.sequence(F.floor((F.col("y") - reach) / row), F.ceil((F.col("y") + reach) / row))))
    rows = rows.withColumn("shift", F.when(F.pmod("i", F.lit(2)) == 1, step / 2).otherwise(F.lit(0.0)))
    cells = rows.withColumn("j", F.explode(F.sequence(F.floor((F.col("x") - reach - F.col("shift")) / step), F.ceil((F.col("x") + reach - F.col("shift")) / step))))
    cells = cells.withColumns({"cx": F.col("j") * step + F.col("shift"), "cy": F.col("i") * row}).where(F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")) <= reach)
    cells = cells.dropDuplicates([*by, "i", "j"])
    return cells.select(*by, F.round(F.col("lat0") + F.col("cy") / KM_PER_LAT, 6).alias("lat"), F.round(F.col("lng0") + F.col("cx") / F.col("km_lng"), 6).alias("lng"))


def hex_lattice(spark: SparkSession, centres: list[tuple[float, float]], area_km: float, cell_km: float = 1.0) -> DataFrame:
    """One lattice of cells over circles around all centres: lat, lng."""
    if cell_km <= 0:
        raise ValueError("cell radius must be positive")
    circles = spark.createDataFrame([(float(a), float(b), float(area_km), float(cell_km)) for a, b in centres], "lat double, lng double, area_km double, cell_km double")
    return lattice(circles.withColumn("one", F.lit(1)), ["one"]).select("lat", "lng")


def covered(points: DataFrame, cells: DataFrame, cell_km: float) -> DataFrame:
    """``points`` (lat, lng) with whether a cell covers each; cells meet points in equal grid squares."""
    lat_step = cell_km / KM_PER_LAT
    lng_step = cell_km / (KM_PER_LNG * 0.9)
    own = cells.select(F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    around = own.withColumn("gy", F.explode(F.expr(f"sequence(floor(c_lat / {lat_step}) - 1, floor(c_lat / {lat_step}) + 1)"))).withColumn(
        "gx", F.explode(F.expr(f"sequence(floor(c_lng / {lng_step}) - 2, floor(c_lng / {lng_step}) + 2)"))
    )
    keyed = points.withColumn("gy", F.floor(F.col("lat") / lat_step)).withColumn("gx", F.floor(F.col("lng") / lng_step))
    dx = (F.col("lng") - F.col("c_lng")) * KM_PER_LNG * F.cos(F.radians("lat"))
    dy = (F.col("lat") - F.col("c_lat")) * KM_PER_LAT
    hits = keyed.join(around, ["gy", "gx"]).where(F.hypot(dx, dy) <= cell_km).select("lat", "lng").distinct().withColumn("covered", F.lit(True))
    return points.join(hits, ["lat", "lng"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def grid_pairs(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of rows within ``metres``: left columns l_*, right columns r_*, and ``dist``.

    Both sides need lat and lng.  Each right row is sent to its own and the eight
    neighbouring squares, so rows meet by an equality join.
    """
    lat_step = metres / 110_000.0
    lng_step = metres / 90_000.0
    cell = lambda c, step: F.floor(F.col(c) / step)
    a = left.where("lat IS NOT NULL AND lng IS NOT NULL").select(*(F.col(c).alias(f"l_{c}") for c in left.columns), cell("lat", lat_step).alias("gy"), cell("lng", lng_step).alias("gx"))
    near = lambda c, step: F.explode(F.sequence(cell(c, step) - 1, cell(c, step) + 1))
    b = right.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("gy", near("lat", lat_step)).withColumn("gx", near("lng", lng_step))
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), "gy", "gx")
    dist = haversine(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng"), M)
    return a.join(b, ["gy", "gx"]).withColumn("dist", dist).where(F.col("dist") <= metres).drop("gy", "gx")
