"""VE-9, VE-13, VE-15, VE-16, VE-17, JN-12: shapes built from other shapes: buffers in metres, aligned polygons, study areas, landslides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.functions.projections import convert_ring
from scarpline.operators import overlay, polygons

RING = ("poly_id", "part", "hole", "ring")


def buffer_metres(rings: DataFrame, metres: Column, epsg: int, square: float, corners: int = 64) -> DataFrame:
    """VE-9: rings in degrees grown (or shrunk) by metres on the plane of a code, in degrees again; square: side of the squares in metres."""
    there = convert_ring(F.col("ring"), F.lit(4326), F.lit(epsg))
    grown = overlay.buffer(rings.withColumn("ring", there), metres, square, corners)
    return grown.withColumn("ring", convert_ring(F.col("ring"), F.lit(epsg), F.lit(4326)))


def align(rings: DataFrame, method: str, tolerance: float, square: float) -> DataFrame:
    """VE-13: polygons whose borders should meet: vertices to the nearest multiple of the tolerance (round), or to the nearest rounded vertex of all (snap), or all shrunk by it (buffer)."""
    if method == "round":
        return rings.withColumn("ring", polygons.round_ring(F.col("ring"), tolerance)).filter(F.size("ring") > 0)
    if method == "snap":
        near = lambda v: F.bround(v / tolerance) * tolerance
        vertices = rings.select(F.explode("ring").alias("p")).select(near(F.col("p.x")).alias("rx"), near(F.col("p.y")).alias("ry")).distinct()
        return polygons.snap_vertices(rings, vertices.withColumn("ref", F.struct("rx", "ry")), square)
    return overlay.buffer(rings, F.lit(-float(tolerance)), square)


def extremes(rings: DataFrame) -> DataFrame:
    """VE-15: one row (x_min, x_max, y_min, y_max) around all rings."""
    return polygons.measures(rings).agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))


def study_area(rings: DataFrame, square: float) -> DataFrame:
    """VE-15: rings (poly_id 0) of the union of boxes, file polygons or buffered points, repaired on the way."""
    return overlay.rings_of(overlay.union(rings, square)).select(*RING)


def around_points(points: DataFrame, radius: float, shape: str = "circle") -> DataFrame:
    """VE-15: a ring for each point (poly_id, x, y): a circle, or a square of half side radius."""
    make = {"circle": polygons.circle, "square": polygons.square}[shape]
    return points.select("poly_id", F.lit(0).alias("part"), F.lit(False).alias("hole"), make(F.col("x"), F.col("y"), F.lit(float(radius))).alias("ring"))


def refine_area(area: DataFrame, removed: DataFrame, square: float) -> DataFrame:
    """VE-16: rings of a study area without the polygons of the removed classes."""
    return overlay.rings_of(overlay.subtract(area, removed, square)).select(*RING)


def _around_paths(paths: DataFrame, radius: float, corners: int) -> DataFrame:
    """Rings around open paths (poly_id, ring): a strip along each step, a circle around each point."""
    each = paths.select("poly_id", F.posexplode("ring").alias("i", "a"), F.col("ring").alias("r")).select("poly_id", "a", F.get("r", F.col("i") + 1).alias("b"))
    a, b = F.col("a"), F.col("b")
    length = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    nx, ny = -(b["y"] - a["y"]) / length * radius, (b["x"] - a["x"]) / length * radius
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    strip = F.when(length > 0, F.array(at(a["x"] - nx, a["y"] - ny), at(b["x"] - nx, b["y"] - ny), at(b["x"] + nx, b["y"] + ny), at(a["x"] + nx, a["y"] + ny)))
    turn = 2 * math.pi / corners
    disc = F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda k: at(a["x"] + radius * F.cos(k * turn), a["y"] + radius * F.sin(k * turn)))
    return each.select("poly_id", F.explode(F.array(strip, disc)).alias("ring")).filter("ring IS NOT NULL").select("poly_id", F.lit(0).alias("part"), F.lit(False).alias("hole"), "ring")


def landslide_problems(points: DataFrame, sources: DataFrame) -> DataFrame:
    """VE-17: (id, problem) of points (id, src) whose id is missing in the source that they name, or is that of several features there."""
    known = sources.groupBy("src", "id").agg(F.count_distinct("feature").alias("n"))
    met = points.filter("src IS NOT NULL AND src <> ''").join(known, ["src", "id"], "left")
    return met.withColumn("problem", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "several")).filter("problem IS NOT NULL").select("id", "problem")


def landslide_polygons(points: DataFrame, sources: DataFrame, radius: float, square: float, shape: str = "circle", corners: int = 64) -> DataFrame:
    """VE-17, JN-12, SC-16: rings (poly_id, part, hole, ring, fake) of points (id: long, src, x, y) on a plane.

    A point takes the shape of its id in the source it names; sources: (src, id, feature, kind, part, hole, ring) of all layers on the same
    plane, kind polygon, line or point. Lines and points are grown by the radius. A point without a source, or whose id its source doesn't
    have, gets a circle or square of the radius. Both, and grown ones, are fake. A point whose id has several features gets nothing, see
    landslide_problems. Points of one id and source share a shape.
    """
    counted = sources.groupBy("src", "id").agg(F.count_distinct("feature").alias("n"))
    # null sources meet nothing and stay, as do ids that a source lacks
    met = points.join(counted, ["src", "id"], "left")
    alone = met.filter("n IS NULL").select(F.col("id").alias("poly_id"), "x", "y")
    # points are few bytes but their circles are much work, so they are spread first
    fakes = around_points(alone.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "poly_id"), radius, shape)
    own = met.filter("n = 1").select("src", "id").distinct().join(sources, ["src", "id"]).select(F.col("id").alias("poly_id"), "kind", "part", "hole", "ring")
    around = _around_paths(own.filter("kind <> 'polygon'"), radius, corners)
    grown = overlay.closed(around, lambda some: overlay.sides(some, F.col("poly_id")), "union", square).withColumn("poly_id", F.col("space")).select(*RING)
    flagged = lambda df, fake: df.select(F.col("poly_id").cast("long").alias("poly_id"), F.col("part").cast("long").alias("part"), "hole", "ring", F.lit(fake).alias("fake"))
    return flagged(own.filter("kind = 'polygon'"), False).union(flagged(grown, True)).union(flagged(fakes, True))
