"""Polygons as tables of rings (poly_id, part, hole, ring: array of x, y): building, measures, rounding, clipping, and sets of cells.

Unions, differences and intersections of any polygons are taken on the grid cells that they cover; clipping to boxes is
exact on the rings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
CELL = ("tile", "row", "col")


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """VE-1: the four corners, counter-clockwise from the lower left."""
    return F.array(_point(x_min, y_min), _point(x_max, y_min), _point(x_max, y_max), _point(x_min, y_max))


def circle(x: Column, y: Column, radius: Column, corners: int = 64) -> Column:
    """VE-2: a regular polygon around a point, from the east."""
    turn = 2 * math.pi / corners
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda k: _point(x + radius * F.cos(k * turn), y + radius * F.sin(k * turn)))


def square(x: Column, y: Column, radius: Column) -> Column:
    """VE-2: the square of half side radius around a point."""
    return rectangle(x - radius, x + radius, y - radius, y + radius)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: expressions that name a ring several times would multiply when nested."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_ring(ring: Column) -> Column:
    """VE-6, VE-7: without repeated neighbours and closing point; empty if fewer than three points are left."""
    last = lambda r: F.get(r, F.size(r) - 1)
    distinct = lambda r: F.filter(r, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(r, i - 1)))
    opened = lambda r: F.when((F.size(r) > 1) & F.get(r, F.lit(0)).eqNullSafe(last(r)), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)
    return _let(_let(_let(ring, distinct), opened), lambda r: F.when(F.size(r) >= 3, r).otherwise(F.array().cast(POINTS)))


def round_ring(ring: Column, tolerance: float) -> Column:
    """VE-12: vertices to multiples of the tolerance, halves to the even one."""
    near = lambda v: F.bround(v / tolerance) * tolerance
    return clean_ring(F.transform(ring, lambda p: _point(near(p["x"]), near(p["y"]))))


def _sides(ring: Column) -> Column:
    """Each vertex (a) with the next one (b), round to the first."""
    after = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return _let(ring, lambda r: F.zip_with(r, after(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def ring_area(ring: Column) -> Column:
    """VE-18: signed, positive if counter-clockwise; from the first vertex, so that large coordinates cancel first."""

    def total(r):
        o = F.get(r, F.lit(0))
        cross = lambda s: (s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"]) - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"])
        return F.aggregate(_sides(r), F.lit(0.0), lambda acc, s: acc + cross(s)) / 2

    return _let(ring, total)


def ring_length(ring: Column) -> Column:
    """VE-18: the length of the closed ring."""
    return F.aggregate(_sides(ring), F.lit(0.0), lambda acc, s: acc + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def measures(rings: DataFrame) -> DataFrame:
    """VE-18, CO-12, AG-11: per polygon its area without holes, boundary length and bounding box."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    own = rings.select("poly_id", (F.abs(ring_area(F.col("ring"))) * F.when(F.col("hole"), -1).otherwise(1)).alias("a"), ring_length(F.col("ring")).alias("l"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    return own.groupBy("poly_id").agg(F.sum("a").alias("area"), F.sum("l").alias("length"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.min("y0").alias("y_min"), F.max("y1").alias("y_max"))


def edges(rings: DataFrame) -> DataFrame:
    """The sides (poly_id, x1, y1, x2, y2) of all rings; a hole's sides are crossed like any other."""
    each = rings.select("poly_id", F.explode(_sides(F.col("ring"))).alias("s"))
    return each.select("poly_id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def clip_to_box(rings: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    """VE-4 with a rectangle: each ring cut at the four sides in turn; rings outside go.

    Parts of a ring that the box separates stay joined along its border, so areas and covered cells are right.
    """
    ring = F.col("ring")
    for axis, limit, sign in (("x", x_min, 1), ("x", x_max, -1), ("y", y_min, 1), ("y", y_max, -1)):
        ring = _cut(ring, axis, limit, sign)
    return rings.withColumn("ring", clean_ring(ring)).filter(F.size("ring") > 0)


def _cut(ring: Column, axis: str, limit: float, sign: int) -> Column:
    """The part of a ring on one side of a line across an axis."""
    other = "y" if axis == "x" else "x"
    depth = lambda p: (p[axis] - limit) * sign

    def kept(s):
        a, b = s["a"], s["b"]
        across = a[other] + (b[other] - a[other]) * depth(a) / F.nullif(depth(a) - depth(b), F.lit(0.0))
        border = _point(F.lit(limit), across) if axis == "x" else _point(across, F.lit(limit))
        stays, goes = (depth(a) >= 0), (depth(b) >= 0)
        return F.when(stays & goes, F.array(b)).when(stays, F.array(border)).when(goes, F.array(border, b)).otherwise(F.array().cast(POINTS))

    return F.flatten(F.transform(_sides(ring), kept))


def snap_vertices(rings: DataFrame, targets: DataFrame, cell: float) -> DataFrame:
    """VE-13: every vertex moved to the nearest of targets (ref, rx, ry), whatever the distance; rings are put together again."""
    from scarpline.operators.neighbours import nearest

    keys = ["poly_id", "part", "hole"]
    own = rings.select(*keys, F.posexplode("ring").alias("seq", "p")).select(*keys, "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    own = own.withColumn("id", F.struct(*keys, "seq"))
    met = nearest(own.select("id", "x", "y"), targets, cell).join(targets, "ref").select("id.*", _point(F.col("rx"), F.col("ry")).alias("p"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"])
    return met.groupBy(*keys).agg(clean_ring(ordered).alias("ring")).filter(F.size("ring") > 0)


def union_cells(covered: DataFrame, by: str | None = None) -> DataFrame:
    """VE-3, AG-4: the cells (tile, row, col) of all polygons, or of those of each value of a column."""
    return covered.select(*([by] if by else []), *CELL).distinct()


def intersect_cells(covered: DataFrame, mask: DataFrame) -> DataFrame:
    """VE-4: the covered cells that the mask's polygons cover too."""
    return covered.join(mask.select(*CELL), list(CELL), "left_semi")


def subtract_cells(covered: DataFrame, mask: DataFrame) -> DataFrame:
    """VE-5, VE-16: the covered cells that none of the mask's polygons covers."""
    return covered.join(mask.select(*CELL), list(CELL), "left_anti")


def resolve_overlaps(covered: DataFrame, priority: str = "priority") -> DataFrame:
    """VE-14: each cell once, for the polygon of the least priority number, of equals the least poly_id."""
    return covered.groupBy(*CELL).agg(F.min(F.struct(priority, "poly_id")).alias("m")).select(*CELL, "m.poly_id")


def alignment(covered: DataFrame, cell_area: float = 1.0, tolerance: float = 1e-7) -> DataFrame:
    """VE-10, AG-11: one row with the sum of areas, the area of the union, and whether they agree."""
    per_cell = covered.groupBy(*CELL).agg(F.count("*").alias("n"))
    total = per_cell.agg((F.coalesce(F.sum("n"), F.lit(0)) * cell_area).alias("sum_area"), (F.count("*") * cell_area).alias("union_area"))
    return total.withColumn("aligned", F.col("sum_area") - F.col("union_area") <= tolerance)


def overlaps(covered: DataFrame) -> DataFrame:
    """VE-11: pairs (a, b, shared, kind) of polygons with cells in common, a < b; kind is overlaps, within or contains.

    The pairs come from the polygons of each cell, so polygons that share none never meet.
    """
    sizes = covered.groupBy("poly_id").agg(F.count("*").alias("size"))
    listed = covered.groupBy(*CELL).agg(F.sort_array(F.collect_set("poly_id")).alias("p")).filter(F.size("p") > 1)
    pairs = listed.select(F.explode(F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("shared"))
    met = pairs.join(sizes.select(F.col("poly_id").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("poly_id").alias("b"), F.col("size").alias("sb")), "b")
    kind = F.when(F.col("shared") == F.col("sa"), "within").when(F.col("shared") == F.col("sb"), "contains").otherwise("overlaps")
    return met.select("a", "b", "shared", kind.alias("kind"))


def path_lengths(points: DataFrame, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """WN-12: the plane and spatial length from the start of each path of points (x, y, z) to each of its points.

    Points of equal seq go by their coordinates.
    """
    order = Window.partitionBy(path).orderBy(seq, "x", "y", "z")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    d = {c: F.col(c) - F.lag(c).over(order) for c in "xyz"}
    steps = points.withColumns({"_2": F.coalesce(F.sqrt(d["x"] ** 2 + d["y"] ** 2), F.lit(0.0)), "_3": F.coalesce(F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2), F.lit(0.0))})
    return steps.withColumns({"length_2d": F.sum("_2").over(so_far), "length_3d": F.sum("_3").over(so_far)}).drop("_2", "_3")
