"""Lattices don't depend on the order in which their centres come."""

from tallyloom.functions import geo


def test_cells_at_just_the_reach(spark):
    # The middle of each group is a centre, and cells at just its reach belong to it on both sides.
    rows = [(16 + g / 10 + a / 100, 100.2 + b / 100, 0.5, 0.25, g) for g in range(10) for a in (1, 3, 5, 7, 9) for b in range(7)]
    circles = spark.createDataFrame(rows, "lat double, lng double, area_km double, cell_km double, g int")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), set()
    for parts in (1, 3, 7, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.add(tuple(sorted(map(tuple, geo.lattice(circles, ["g"]).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1
    cells = set(found.pop())
    for g in range(10):
        own = [lat for k, lat, lng in cells if k == g and lng == 100.23]
        assert {round(16 + g / 10 + 0.05 + k * 0.375 / geo.KM_PER_LAT, 6) for k in (-2, 2)} <= set(own), g
