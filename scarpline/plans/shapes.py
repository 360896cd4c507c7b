"""Registered queries on rings and projections, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.functions import projections, scalars
from scarpline.operators import overlay, polygons, shapes
from scarpline.plans.fixtures import CELLS, cells, read

SQUARE = 4.0
CORNERS = 64


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scarpline.plans import areas

    return areas._boxes(spark, sf_dir)


def _bows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring that crosses itself in the middle of each supplier's rectangle."""
    outer = _boxes(spark, sf_dir).filter("NOT hole")
    at = lambda i: F.get("ring", F.lit(i))
    return outer.withColumn("ring", F.array(at(0), at(2), at(1), at(3)))


def _areas(found: DataFrame, name: str = "poly_id") -> DataFrame:
    from scarpline.plans import queries as base

    return base.rounded(overlay.areas(found).filter("area > 1e-7").select(F.col("out").alias(name), "area"), "area")


def _divided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = _boxes(spark, sf_dir)
    return b.filter("poly_id % 5 <> 0"), b.filter("poly_id % 5 = 0")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers all over the globe, away from the poles."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), (F.pmod(k * 37, F.lit(3599)) * 0.1 - 179.9).alias("lon"), (F.pmod(k * 29, F.lit(1601)) * 0.1 - 80).alias("lat"))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("tile", "row", "col", (10 + F.col("col") * 0.01).alias("x"), (45 - F.col("row") * 0.01).alias("y"))


def _slides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as points, every fifth without a source, and suppliers' boxes (every fourth a line, every thirteenth there twice) as a source."""
    k = F.col("c_custkey")
    points = read(spark, sf_dir, "customer").select(k.cast("long").alias("id"), F.when(k % 5 != 0, "boxes").alias("src"), (F.pmod(k, F.lit(100)) * 3.0).alias("x"), (F.floor(k / 100) * 3.0).alias("y"))
    b = _boxes(spark, sf_dir).withColumn("kind", F.when(F.col("poly_id") % 4 == 0, "line").otherwise("polygon")).filter("kind = 'polygon' OR NOT hole")
    line = F.when(F.col("kind") == "line", F.slice("ring", 1, 2)).otherwise(F.col("ring"))
    twice = F.explode(F.when(F.col("poly_id") % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("feature")
    return points, b.select(F.lit("boxes").alias("src"), F.col("poly_id").cast("long").alias("id"), twice, "kind", "part", "hole", line.alias("ring"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scarpline.plans import queries as base

    rounded = base.rounded

    def utm(s, d):
        p = _places(s, d).withColumn("epsg", scalars.utm_epsg(F.col("lon"), F.col("lat")))
        east, north = projections.convert(F.col("lon"), F.col("lat"), F.lit(4326), F.col("epsg"))
        return p.withColumns({"east": east, "north": north})

    def back(s, d):
        lon, lat = projections.convert(F.col("east"), F.col("north"), F.col("epsg"), F.lit(4326))
        return rounded(utm(s, d).select("id", lon.alias("lon"), lat.alias("lat")), "lon", "lat", digits=8)

    def mercator(s, d):
        ring = projections.convert_ring(F.col("ring"), F.lit(4326), F.lit(3857))
        return rounded(polygons.measures(_boxes(s, d).withColumn("ring", ring)).select("poly_id", (F.col("area") / 1e6).alias("area")), "area", digits=4)

    def regrid(s, d):
        moved = projections.convert_cells(_centres(s, d), F.lit(4326), F.lit(3857))
        return rounded(projections.affine(moved), "a", "c", "e", "f", digits=4)

    def buffers(s, d):
        outer = _boxes(s, d).filter("NOT hole")
        found = overlay.buffer(outer, (F.pmod("poly_id", F.lit(3)) - 1) * 0.25, SQUARE, CORNERS)
        return rounded(polygons.measures(found).select("poly_id", "area"), "area")

    def repaired(s, d):
        found = overlay.repair(_bows(s, d), SQUARE)
        return rounded(found.groupBy("poly_id").agg(F.count("*").alias("rings"), F.sum(polygons.ring_area(F.col("ring"))).alias("area")), "area")

    def rings(s, d):
        found = overlay.rings_of(overlay.union(_boxes(s, d), SQUARE, F.pmod("poly_id", F.lit(4))))
        own = found.groupBy("space").agg(F.sum(polygons.ring_area(F.col("ring"))).alias("area"), F.sum(polygons.ring_length(F.col("ring"))).alias("length"))
        return rounded(own, "area", "length")

    def slides(s, d):
        found = shapes.landslide_polygons(*_slides(s, d), radius=1.0, square=SQUARE)
        # a polygon is one or the other, so both name it and its rings are made once
        return rounded(polygons.measures(found.withColumn("poly_id", F.struct("poly_id", "fake"))).select("poly_id.poly_id", "poly_id.fake", "area"), "area")

    def area(s, d):
        k = F.col("s_suppkey")
        points = read(s, d, "supplier").select(k.alias("poly_id"), F.pmod(k, F.lit(40)).cast("double").alias("x"), F.floor(k / 40).cast("double").alias("y"))
        found = shapes.study_area(shapes.around_points(points, 0.75, "square"), SQUARE)
        total = polygons.measures(found).select("area")
        return rounded(shapes.extremes(found).join(total), "area", "x_min", "x_max", "y_min", "y_max")  # one row each

    def union(s, d):
        found = overlay.areas(overlay.union(_boxes(s, d), SQUARE, F.pmod("poly_id", F.lit(4))))
        return rounded(found.select("space", "area"), "area")

    return {
        "ve3_union_rings": union,
        "ve3_union_boundaries": rings,
        "ve4_intersect_rings": lambda s, d: _areas(overlay.intersect(*_divided(s, d), SQUARE)),
        "ve5_subtract_rings": lambda s, d: _areas(overlay.subtract(*_divided(s, d), SQUARE)),
        "ve14_resolve_rings": lambda s, d: _areas(overlay.resolve(_boxes(s, d), F.pmod("poly_id", F.lit(7)), SQUARE)),
        "ve10_alignment_rings": lambda s, d: rounded(overlay.alignment(_boxes(s, d), SQUARE), "sum_area", "union_area"),
        "ve11_overlaps_rings": lambda s, d: rounded(overlay.overlaps(_boxes(s, d), SQUARE), "shared"),
        "ve6_repair_rings": repaired,
        "ve9_buffer_rings": buffers,
        "ve17_landslides": slides,
        "ve17_problems": lambda s, d: shapes.landslide_problems(*_slides(s, d)),
        "ve15_study_area": area,
        "ve13_shrunk": lambda s, d: rounded(polygons.measures(shapes.align(_boxes(s, d).filter("NOT hole"), "buffer", 0.125, SQUARE)).select("poly_id", "area"), "area"),
        "co1_to_utm": lambda s, d: rounded(utm(s, d).select("id", "epsg", "east", "north"), "east", "north", digits=3),
        "co1_round_trip": back,
        "co13_projected": lambda s, d: rounded(projections.with_projected(_places(s, d).withColumns({"lon": 12 + F.col("lon") / 100, "lat": 45 + F.col("lat") / 100})).select("id", "prj_epsg", "prj_x", "prj_y"), "prj_x", "prj_y", digits=3),
        "ve8_reproject_rings": mercator,
        "co7_affine": regrid,
    }


def _utm_sql(of: str, epsg: str, lon: str, lat: str, names: tuple[str, str]) -> str:
    """Krueger's series written out over a table."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a1, a2, a3 = n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240
    e = 2 * math.sqrt(n) / (1 + n)
    num = lambda v: f"CAST({v!r} AS DOUBLE)"
    k = num(0.9996 * radius)
    term = lambda a, j: f"{num(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)"
    rise = lambda a, j: f"{num(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    return f"""u1 AS (SELECT *, {epsg} AS code, radians({lat}) AS phi, radians({lon} - (({epsg}) % 100 * 6 - 183)) AS dl FROM {of}),
u2 AS (SELECT *, sinh(atanh(sin(phi)) - {num(e)} * atanh({num(e)} * sin(phi))) AS t FROM u1),
u3 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM u2),
u4 AS (SELECT *, 500000 + {k} * (eta + {term(a1, 1)} + {term(a2, 2)} + {term(a3, 3)}) AS {names[0]}, CASE WHEN code >= 32700 THEN 10000000.0 ELSE 0.0 END + {k} * (xi + {rise(a1, 1)} + {rise(a2, 2)} + {rise(a3, 3)}) AS {names[1]} FROM u3)"""


def oracle_sql() -> dict[str, str]:
    boxes = "b AS (SELECT s_suppkey AS k, s_suppkey % 40 AS x, s_suppkey // 40 AS y, s_suppkey % 7 + 2 AS w FROM supplier)"
    # every coordinate is a multiple of a quarter, so areas are counts of squares of a quarter
    q = f"{boxes}, qx AS (SELECT *, unnest(range(4 * x, 4 * (x + w))) AS i FROM b), q AS (SELECT k, i, j FROM (SELECT *, unnest(range(4 * y, 4 * (y + 2))) AS j FROM qx) WHERE NOT (k % 3 = 0 AND i IN (4 * x + 3, 4 * x + 4) AND j IN (4 * y + 3, 4 * y + 4)))"
    mask = "m AS (SELECT DISTINCT i, j FROM q WHERE k % 5 = 0)"
    area = "round(CAST(count(*) / 16.0 AS DOUBLE), 6) AS area"
    disc = CORNERS / 2 * math.sin(2 * math.pi / CORNERS)
    places = "p AS (SELECT c_custkey AS id, (c_custkey * 37) % 3599 * CAST(0.1 AS DOUBLE) - CAST(179.9 AS DOUBLE) AS lon, (c_custkey * 29) % 1601 * CAST(0.1 AS DOUBLE) - 80 AS lat FROM customer)"
    epsg = "CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, floor((lon + 180) / 6) + 1) AS INT)"
    radius = "CAST(6378137.0 AS DOUBLE)"
    up = lambda lat: f"{radius} * ln(tan(radians({lat}) / 2 + pi() / 4))"
    own = f"{boxes}, g AS (SELECT *, radians(w) * {radius} * ({up('y + 2.0')} - {up('CAST(y AS DOUBLE)')}) AS a, radians(0.5) * {radius} * ({up('y + 1.25')} - {up('y + 0.75')}) AS h FROM b)"
    centres = f"{CELLS}, c AS (SELECT tile, row, col, radians(10 + col * CAST(0.01 AS DOUBLE)) * {radius} AS x, {up('(45 - row * CAST(0.01 AS DOUBLE))')} AS y FROM cells)"
    return {
        "ve3_union_rings": f"WITH {q} SELECT CAST(k % 4 AS BIGINT) AS space, round(CAST(count(DISTINCT (i, j)) / 16.0 AS DOUBLE), 6) AS area FROM q GROUP BY k % 4",
        "ve3_union_boundaries": f"""WITH {q}, u AS (SELECT DISTINCT k % 4 AS s, i, j FROM q),
e AS (SELECT s, count(*) AS n FROM (SELECT s, i + d.di AS i, j + d.dj AS j FROM u, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(di, dj)) x WHERE (s, i, j) NOT IN (SELECT (s, i, j) FROM u) GROUP BY s)
SELECT CAST(u.s AS BIGINT) AS space, round(CAST(count(*) / 16.0 AS DOUBLE), 6) AS area, round(CAST(any_value(e.n) / 4.0 AS DOUBLE), 6) AS length FROM u JOIN e USING (s) GROUP BY u.s""",
        "ve4_intersect_rings": f"WITH {q}, {mask} SELECT k AS poly_id, {area} FROM q JOIN m USING (i, j) WHERE k % 5 <> 0 GROUP BY k",
        "ve5_subtract_rings": f"WITH {q}, {mask} SELECT k AS poly_id, {area} FROM q ANTI JOIN m USING (i, j) WHERE k % 5 <> 0 GROUP BY k",
        "ve14_resolve_rings": f"WITH {q}, f AS (SELECT i, j, min((k % 7, k))[2] AS k FROM q GROUP BY i, j) SELECT k AS poly_id, {area} FROM f GROUP BY k",
        "ve10_alignment_rings": f"WITH {q} SELECT round(CAST(count(*) / 16.0 AS DOUBLE), 6) AS sum_area, round(CAST(count(DISTINCT (i, j)) / 16.0 AS DOUBLE), 6) AS union_area, count(*) = count(DISTINCT (i, j)) AS aligned FROM q",
        "ve11_overlaps_rings": f"WITH {q}, n AS (SELECT k, count(*) AS n FROM q GROUP BY k), s AS (SELECT x.k AS a, z.k AS b, count(*) AS c FROM q x JOIN q z ON x.i = z.i AND x.j = z.j AND x.k < z.k GROUP BY ALL) SELECT a, b, round(CAST(c / 16.0 AS DOUBLE), 6) AS shared, CASE WHEN c = na.n THEN 'within' WHEN c = nb.n THEN 'contains' ELSE 'overlaps' END AS kind FROM s JOIN n na ON na.k = a JOIN n nb ON nb.k = b",
        "ve6_repair_rings": f"WITH {boxes} SELECT k AS poly_id, CAST(2 AS BIGINT) AS rings, round(CAST(w AS DOUBLE), 6) AS area FROM b",
        "ve9_buffer_rings": f"WITH {boxes} SELECT k AS poly_id, round(CAST(CASE k % 3 WHEN 0 THEN (w - 0.5) * 1.5 WHEN 1 THEN w * 2 ELSE w * 2 + (2 * w + 4) * 0.25 + {disc!r} * 0.0625 END AS DOUBLE), 6) AS area FROM b",
        "ve17_landslides": f"WITH {boxes}, c AS (SELECT c_custkey AS id, c_custkey % 5 <> 0 AS named FROM customer) SELECT c.id AS poly_id, (NOT named OR b.k IS NULL OR k % 4 = 0) AS fake, round(CAST(CASE WHEN NOT named OR b.k IS NULL THEN {disc!r} WHEN k % 4 = 0 THEN {disc!r} + 2 * w ELSE 2 * w - CASE WHEN k % 3 = 0 THEN 0.25 ELSE 0 END END AS DOUBLE), 6) AS area FROM c LEFT JOIN b ON b.k = c.id WHERE NOT named OR b.k IS NULL OR k % 13 <> 0",
        "ve17_problems": "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'several' END AS problem FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 5 <> 0 AND (s_suppkey IS NULL OR s_suppkey % 13 = 0)",
        "ve15_study_area": "WITH p AS (SELECT s_suppkey % 40 AS x, s_suppkey // 40 AS y FROM supplier), q AS (SELECT DISTINCT i, j FROM (SELECT *, unnest(range(4 * y - 3, 4 * y + 3)) AS j FROM (SELECT *, unnest(range(4 * x - 3, 4 * x + 3)) AS i FROM p))) SELECT round(CAST(count(*) / 16.0 AS DOUBLE), 6) AS area, round(CAST(min(i) / 4.0 AS DOUBLE), 6) AS x_min, round(CAST((max(i) + 1) / 4.0 AS DOUBLE), 6) AS x_max, round(CAST(min(j) / 4.0 AS DOUBLE), 6) AS y_min, round(CAST((max(j) + 1) / 4.0 AS DOUBLE), 6) AS y_max FROM q",
        "ve13_shrunk": f"WITH {boxes} SELECT k AS poly_id, round(CAST((w - 0.25) * 1.75 AS DOUBLE), 6) AS area FROM b",
        "co1_to_utm": f"WITH {places}, {_utm_sql('p', epsg, 'lon', 'lat', ('east', 'north'))} SELECT id, code AS epsg, round(east, 3) AS east, round(north, 3) + 0.0 AS north FROM u4",
        "co1_round_trip": f"WITH {places} SELECT id, round(lon, 8) + 0.0 AS lon, round(lat, 8) + 0.0 AS lat FROM p",
        "co13_projected": f"WITH {places}, s AS (SELECT id, 12 + lon / 100 AS lon, 45 + lat / 100 AS lat FROM p), z AS (SELECT CAST(32600 + floor((min(lon) + 180) / 6) + 1 AS INT) AS z FROM s), w AS (SELECT s.*, z FROM s CROSS JOIN z), {_utm_sql('w', 'z', 'lon', 'lat', ('east', 'north'))} SELECT id, code AS prj_epsg, round(east, 3) AS prj_x, round(north, 3) AS prj_y FROM u4",
        "ve8_reproject_rings": f"WITH {own} SELECT k AS poly_id, round((a - CASE WHEN k % 3 = 0 THEN h ELSE 0 END) / 1e6, 4) AS area FROM g",
        "co7_affine": f"WITH {centres}, d AS (SELECT *, lead(x) OVER (PARTITION BY tile, row ORDER BY col) - x AS dx, lead(col) OVER (PARTITION BY tile, row ORDER BY col) - col AS dc, lead(y) OVER (PARTITION BY tile, col ORDER BY row) - y AS dy, lead(row) OVER (PARTITION BY tile, col ORDER BY row) - row AS dr FROM c), m AS (SELECT tile, avg(dx / dc) AS a, avg(dy / dr) AS e, min((row, col, x, y)) AS o FROM d GROUP BY tile) SELECT tile, round(a, 4) AS a, round(o[3] - (o[2] + 0.5) * a, 4) AS c, round(e, 4) AS e, round(o[4] - (o[1] + 0.5) * e, 4) AS f FROM m",
    }
