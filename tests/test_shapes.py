"""Shapes from shapes: metric buffers there and back, alignment, study areas with classes taken out, landslides."""

import math

import pytest
from pyspark.sql import functions as F

from scarpline.functions.projections import convert_ring
from scarpline.operators import polygons, shapes

RINGS = "poly_id long, part int, hole boolean, ring array<struct<x:double,y:double>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def areas(df):
    return {r.poly_id: r.area for r in polygons.measures(df).collect()}


def test_metric_buffer_in_degrees(spark):
    plane = spark.createDataFrame([(1, 0, False, box(500000.0, 5000000.0, 100.0, 50.0))], RINGS)
    degrees = plane.withColumn("ring", convert_ring(F.col("ring"), F.lit(32632), F.lit(4326)))
    grown = shapes.buffer_metres(degrees, F.lit(10.0), 32632, 40.0)
    back = grown.withColumn("ring", convert_ring(F.col("ring"), F.lit(4326), F.lit(32632)))
    assert all(8 < p.x < 10 and 44 < p.y < 46 for r in grown.collect() for p in r.ring)
    assert areas(back)[1] == pytest.approx(5000 + 3000 + 32 * 100 * math.sin(2 * math.pi / 64), abs=0.01)


def test_alignment_and_refined_areas(spark):
    rings = spark.createDataFrame([(1, 0, False, box(0.0, 0.0, 2.04, 1.0)), (2, 0, False, box(1.98, 0.02, 2.0, 1.0))], RINGS)
    assert areas(shapes.align(rings, "round", 0.5, 3.0)) == pytest.approx({1: 2.0, 2: 2.0})
    assert areas(shapes.align(rings, "snap", 0.5, 3.0)) == pytest.approx({1: 2.0, 2: 2.0})
    assert areas(shapes.align(rings, "buffer", 0.1, 3.0)) == pytest.approx({1: 1.84 * 0.8, 2: 1.8 * 0.8})
    area = shapes.study_area(rings, 3.0)
    assert areas(area)[0] == pytest.approx(2.04 + 2.0 - 0.06 * 0.98)
    left = shapes.refine_area(area, spark.createDataFrame([(9, 0, False, box(1.0, 0.25, 1.0, 0.5))], RINGS), 3.0)
    assert areas(left)[0] == pytest.approx(2.04 + 2.0 - 0.06 * 0.98 - 0.5) and left.filter("hole").count() == 1
    assert tuple(shapes.extremes(rings).first()) == (0.0, 3.98, 0.0, 1.02)


def test_landslides(spark):
    points = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, None, 9.0, 9.0), (3, "a", 5.0, 5.0), (4, "b", 0.0, 0.0), (5, "b", 1.0, 1.0), (6, "", 3.0, 3.0)], "id long, src string, x double, y double")
    line = [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)]
    sources = spark.createDataFrame([("a", 1, 1, "polygon", 0, False, box(0.0, 0.0, 4.0, 4.0)), ("a", 1, 1, "polygon", 0, True, box(1.0, 1.0, 1.0, 1.0)), ("b", 4, 1, "line", 0, False, line), ("b", 5, 1, "polygon", 0, False, line), ("b", 5, 2, "polygon", 0, False, line)], "src string, id long, feature int, kind string, part int, hole boolean, ring array<struct<x:double,y:double>>")
    found = shapes.landslide_polygons(points, sources, 1.0, 4.0, "square")
    disc = 32 * math.sin(2 * math.pi / 64)
    assert areas(found) == pytest.approx({1: 15.0, 2: 4.0, 3: 4.0, 4: 14 + disc * 5 / 4 - 1, 6: 4.0})
    assert {r.poly_id: r.fake for r in found.collect()} == {1: False, 2: True, 3: True, 4: True, 6: True}
    assert {tuple(r) for r in shapes.landslide_problems(points, sources).collect()} == {(3, "missing"), (5, "several")}


def test_circles_of_points_are_spread_over_tasks(spark):
    points = spark.range(200).selectExpr("id", "CAST(NULL AS STRING) AS src", "id * 3.0D AS x", "0.0D AS y").coalesce(1)
    sources = spark.createDataFrame([], "src string, id long, feature int, kind string, part int, hole boolean, ring array<struct<x:double,y:double>>")
    found = shapes.landslide_polygons(points, sources, 1.0, 4.0).withColumn("task", F.spark_partition_id())
    assert found.count() == 200 and found.select("task").distinct().count() >= 4
