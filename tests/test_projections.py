"""Coordinates against published values, there and back."""

import pytest
from pyspark.sql import functions as F

from scarpline.functions import projections as pj


def test_known_places_and_round_trips(spark):
    # published: the CN Tower in zone 17
    rows = [(1, -79.387138, 43.642567, 32617), (2, 9.0, 0.0, 32632), (3, 179.99, -79.5, 32760), (4, -179.99, 83.9, 32601), (5, 12.3, 45.6, 3857), (6, 2.0, 51.0, 25831), (7, 1.0, 1.0, 999)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double, epsg int")
    x, y = pj.convert(F.col("lon"), F.col("lat"), F.lit(4326), F.col("epsg"))
    there = df.withColumns({"x": x, "y": y})
    lon, lat = pj.convert(F.col("x"), F.col("y"), F.col("epsg"), F.lit(4258))
    got = {r.id: r for r in there.withColumns({"lon2": lon, "lat2": lat}).collect()}
    assert (got[1].x, got[1].y) == pytest.approx((630084.3, 4833438.6), abs=0.5)
    assert (got[2].x, got[2].y) == pytest.approx((500000, 0), abs=1e-6)
    assert got[7].x is None and got[7].lon2 is None
    for k in range(1, 7):  # a millimetre is about 1e-8 degrees
        assert got[k].lon2 == pytest.approx(got[k].lon, abs=2e-8 if abs(got[k].lat) < 70 else 1e-7)
        assert got[k].lat2 == pytest.approx(got[k].lat, abs=1e-8)


def test_zones_of_boxes_and_of_norway(spark):
    rows = [(11.0, 13.0, 44.0, 46.0), (6.1, 11.9, -1.0, 3.0), (6.1, 11.9, -3.0, -1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").select(pj.box_epsg(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("z"))
    assert [(r.z.epsg, r.z.several) for r in df.collect()] == [(32632, True), (32632, True), (32732, False)]
    places = spark.createDataFrame([(5.0, 60.0), (5.0, 50.0), (10.0, 78.0), (8.9, 78.0), (35.0, 75.0)], "x double, y double")
    assert [r[0] for r in places.select(pj.special_utm_epsg(F.col("x"), F.col("y"))).collect()] == [32632, 32631, 32633, 32631, 32637]
