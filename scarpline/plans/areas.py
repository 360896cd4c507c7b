"""Registered queries on polygons, points, areas, alerts and lookups, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.functions import scalars
from scarpline.operators import alerts, grid, paths, points, polygons
from scarpline.plans import queries as base
from scarpline.plans.fixtures import CELLS, OBS, STATIONS, cells, observations, read, stations
from scarpline.sources import tables

TILES = ((0, 0.05, 0.05, 0.1, 0.1, 8, 12), (1, 1.3, 0.02, 0.04, 0.04, 30, 20))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle around each supplier's place, with a square hole in every third."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select(k.alias("poly_id"), F.pmod(k, F.lit(40)).cast("double").alias("x"), F.floor(k / 40).cast("double").alias("y"), (F.pmod(k, F.lit(7)) + 2).cast("double").alias("w"))
    outer = s.select("poly_id", F.lit(0).alias("part"), F.lit(False).alias("hole"), polygons.rectangle(F.col("x"), F.col("x") + F.col("w"), F.col("y"), F.col("y") + 2).alias("ring"))
    inner = s.filter("poly_id % 3 = 0").select("poly_id", F.lit(0).alias("part"), F.lit(True).alias("hole"), polygons.square(F.col("x") + 1, F.col("y") + 1, F.lit(0.25)).alias("ring"))
    return outer.union(inner)


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._burns(spark, sf_dir).withColumn("poly_id", F.col("priority").cast("int"))


def _tiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TILES, "tile int, x0 double, y0 double, dx double, dy double, rows int, cols int")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell as a pixel of the area of its tile, dealt to all stations in turn."""
    count = read(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("n"))  # one row
    number = F.col("tile") * 1000 + F.col("row") * 50 + F.col("col")
    return cells(spark, sf_dir).join(F.broadcast(count)).select(F.col("tile").alias("area"), "tile", "row", "col", F.pmod(number.cast("long"), F.col("n").cast("long")).alias("station"))


def _area_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.pixel_series(_pixels(spark, sf_dir), observations(spark, sf_dir))


def area_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _area_rows(spark, sf_dir)
    limits = alerts.thresholds(alerts.metric_statistics(rows), mode="max").withColumn("threshold", base.steady(F.col("threshold"), 5))
    found = alerts.alert_times(rows, limits, tolerance_seconds=2 * 86400)
    return found.select("area", "ts", "event", "pixels", F.array_join("stations", ",").alias("stations"))


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base._points(spark, sf_dir)
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return p.select(F.col("id").alias("poly_id"), polygons.round_ring(F.array(at(0.0, 0.0), at(0.3, 0.0), at(0.0, 0.7)), 0.25).alias("ring"))


def _line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_discount") * 100).alias("z"))


#: Paths whose partial score falls below this end; at five points a step of deviation, about one step aside for each step.
PARTIAL_SCORE = 65.0


def _compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.compatible_paths(cells(spark, sf_dir), base._starts(spark, sf_dir), maximum_paths=None, min_partial_score=PARTIAL_SCORE)


def _walk_rows(found: DataFrame) -> DataFrame:
    return found.select("path_id", "steps", "stop_reason", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["row"], c["col"])), ",").alias("cells"), F.round(F.aggregate("deviation", F.lit(0.0), lambda a, v: a + v), 6).alias("deviation"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    rounded = base.rounded
    return {
        "ve18_measures": lambda s, d: rounded(polygons.measures(_boxes(s, d)), "area", "length", "x_min", "x_max", "y_min", "y_max"),
        "ve4_clip_to_box": lambda s, d: rounded(polygons.measures(polygons.clip_to_box(_boxes(s, d).filter("NOT hole"), 5.0, 30.0, 0.5, 20.0)).select("poly_id", "area"), "area"),
        "ve12_round_vertices": lambda s, d: rounded(_triangles(s, d).select("poly_id", F.size("ring").alias("n"), polygons.ring_area(F.col("ring")).alias("area")), "area"),
        "ve3_union_cells": lambda s, d: polygons.union_cells(_covered(s, d)),
        "ve5_subtract_cells": lambda s, d: polygons.subtract_cells(_covered(s, d).filter("poly_id % 2 = 0"), _covered(s, d).filter("poly_id % 2 = 1")).select("tile", "row", "col", "poly_id"),
        "ve10_alignment": lambda s, d: polygons.alignment(_covered(s, d)),
        "ve11_overlaps": lambda s, d: polygons.overlaps(_covered(s, d)),
        "ve14_resolve_overlaps": lambda s, d: polygons.resolve_overlaps(_covered(s, d)),
        "ra12_touched_cells": lambda s, d: grid.cells_touched(base._centred(s, d), base._edges(s)),
        "jn2_nearest_cell": lambda s, d: rounded(points.nearest_cell(base._points(s, d).withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10}), _tiles(s)).select("id", "tile", "row", "col", "distance"), "distance"),
        "in1_nearest_by_steps": lambda s, d: rounded(points.nearest_by_steps(base._points(s, d), stations(s, d)), "distance"),
        "in2_fill_linear": lambda s, d: rounded(points.interpolate(base.series(s, d), stations(s, d)), "value"),
        "in4_fill_radial": lambda s, d: rounded(points.interpolate(base.series(s, d), stations(s, d), "rbf"), "value", digits=4),
        "wn12_path_lengths": lambda s, d: rounded(polygons.path_lengths(_line_points(s, d)).select("path_id", "seq", "length_2d", "length_3d"), "length_2d", "length_3d"),
        "ag6_metric_statistics": lambda s, d: rounded(alerts.metric_statistics(_area_rows(s, d)), "mean", "std", "max", "min"),
        "jn15_station_pixels": lambda s, d: alerts.station_pixels(_pixels(s, d)).select("station", F.size("pixels").alias("n"), F.array_join(F.transform("pixels", lambda p: F.concat_ws(":", p["tile"], p["row"], p["col"])), ",").alias("pixels")),
        "mo4_area_alerts": area_alerts,
        "it2_gradient_paths": lambda s, d: _walk_rows(paths.gradient_paths(cells(s, d).withColumn("z", F.col("z") / 500), base._starts(s, d))),
        "it4_compatible_paths": lambda s, d: _walk_rows(_compatible(s, d)),
        "it3_realism_scores": lambda s, d: rounded(paths.scored_paths(_compatible(s, d)).select("path_id", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["row"], c["col"])), ",").alias("cells"), "score"), "score"),
        "pf5_lookup": lambda s, d: tables.looked_up(read(s, d, "customer"), read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "c_name"),
        "pf7_containment": lambda s, d: tables.column_containment(read(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v")), read(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("v")), ["k", "v"]),
        "pf8_geographic": lambda s, d: read(s, d, "lineitem").groupBy("l_returnflag").agg(scalars.are_geographic(F.col("l_extendedprice") / 500, F.col("l_quantity")).alias("geographic")),
    }


def _compatible_sql(columns: str) -> str:
    """Every path by recursion, with the same stops."""
    score = "greatest(0, 70 * list_avg(list_transform(valid, lambda v: CASE WHEN v THEN 1.0 ELSE 0.0 END)) - 5 * list_avg(dev) - least(60, greatest(0, (7 - abs(list_avg(deg))) * 5)))"
    return f"""WITH RECURSIVE {base.NEIGHBOURS}, ways AS (SELECT *, -slope AS s, -slope >= tan(radians(7)) AS good, -slope < tan(radians(7)) AND -slope >= 0 AS low FROM nb),
info AS MATERIALIZED (SELECT tile, row, col, count(*) AS n, -max((s, -dir))[2] AS steepest, bool_or(good) AS any_good, bool_or(low) AS any_low FROM ways GROUP BY ALL),
open_ways AS MATERIALIZED (SELECT * FROM ways WHERE good OR low),
walk AS (SELECT tile * 100000 + row * 1000 + col AS path_id, tile, row, col, [row || ':' || col] AS path, 0 AS flat, CAST([] AS BOOLEAN[]) AS valid, CAST([] AS DOUBLE[]) AS dev, CAST([] AS DOUBLE[]) AS deg, CAST([] AS DOUBLE[]) AS len, CAST(NULL AS VARCHAR) AS stop FROM cells
  UNION ALL
  SELECT path_id, q.tile, coalesce(y.n_row, q.row), coalesce(y.n_col, q.col), CASE WHEN st IS NULL THEN list_append(path, y.n_row || ':' || y.n_col) ELSE path END, CASE WHEN y.low THEN flat + 1 ELSE 0 END, CASE WHEN st IS NULL THEN list_append(valid, y.good) ELSE valid END,
    CASE WHEN st IS NULL THEN list_append(dev, least(abs(y.dir - steepest), 8 - abs(y.dir - steepest))) ELSE dev END, CASE WHEN st IS NULL THEN list_append(deg, degrees(atan(y.slope))) ELSE deg END, CASE WHEN st IS NULL THEN list_append(len, y.length) ELSE len END, st
  FROM (SELECT w.*, steepest, CASE WHEN n IS NULL OR n < 8 THEN 'edge_reached' WHEN NOT any_good AND NOT any_low THEN 'greater_than_tolerance_opposite_flow' WHEN NOT any_good AND flat = 1 THEN 'invalid_steps_tolerance_reached' WHEN len(valid) >= 4 AND {score} < {PARTIAL_SCORE} - 1e-9 THEN 'low_realism' END AS st
    FROM walk w LEFT JOIN info i ON i.tile = w.tile AND i.row = w.row AND i.col = w.col WHERE w.stop IS NULL AND len(w.valid) < 50) q
  LEFT JOIN open_ways y ON q.st IS NULL AND y.tile = q.tile AND y.row = q.row AND y.col = q.col AND NOT list_contains(path, y.n_row || ':' || y.n_col) AND (NOT y.low OR flat < 1)
  WHERE q.st IS NOT NULL OR y.dir IS NOT NULL),
ended AS (SELECT *, coalesce(stop, 'max_runout') AS stop_reason FROM walk WHERE stop IS NOT NULL OR len(valid) = 50)
SELECT {columns} FROM ended"""


def oracle_sql() -> dict[str, str]:
    covered = f"{base.BURNS}, cv AS (SELECT tile, row, col, CAST(k AS INT) AS poly_id FROM burns)"
    tiles = "tiles(tile, x0, y0, dx, dy, rows, cols) AS (VALUES " + ", ".join(f"({t}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {r}, {c})" for t, x, y, a, b, r, c in TILES) + ")"
    boxes = "b AS (SELECT s_suppkey AS k, s_suppkey % 40 AS x, s_suppkey // 40 AS y, s_suppkey % 7 + 2 AS w FROM supplier)"
    pts = "p AS (SELECT c_custkey AS id, (c_custkey % 37) * CAST(0.006 AS DOUBLE) AS x, (c_custkey % 29) * CAST(0.005 AS DOUBLE) AS y FROM customer)"
    area = f"{OBS}, {CELLS}, px AS (SELECT tile AS area, (tile * 1000 + row * 50 + col) % (SELECT max(user_id) + 1 FROM events) AS station, count(*) AS pixels FROM cells GROUP BY ALL), rw AS (SELECT area, station, pixels, ts, value FROM obs JOIN px USING (station)), st AS (SELECT area, sum(pixels * value) / sum(pixels) AS mean, sum(pixels) AS n, max(value) AS hi, min(value) AS lo FROM rw GROUP BY area)"
    near = lambda v: f"round_even({v} / 0.25, 0) * 0.25"
    return {
        "ve18_measures": f"WITH {boxes} SELECT k AS poly_id, round(CAST(w * 2 - CASE WHEN k % 3 = 0 THEN 0.25 ELSE 0 END AS DOUBLE), 6) AS area, round(CAST(2 * w + 4 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS DOUBLE), 6) AS length, round(CAST(x AS DOUBLE), 6) AS x_min, round(CAST(x + w AS DOUBLE), 6) AS x_max, round(CAST(y AS DOUBLE), 6) AS y_min, round(CAST(y + 2 AS DOUBLE), 6) AS y_max FROM b",
        "ve4_clip_to_box": f"WITH {boxes}, c AS (SELECT k, least(x + w, 30) - greatest(x, 5) AS cw, least(y + 2, 20) - greatest(y, 0.5) AS ch FROM b) SELECT k AS poly_id, round(CAST(cw * ch AS DOUBLE), 6) AS area FROM c WHERE cw > 0 AND ch > 0",
        "ve12_round_vertices": f"WITH {pts}, r AS (SELECT id, {near('x')} AS x0, {near('(x + 0.3)')} AS x1, {near('x')} AS x2, {near('y')} AS y0, {near('y')} AS y1, {near('(y + 0.7)')} AS y2 FROM p) SELECT id AS poly_id, 3 AS n, round(((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2, 6) AS area FROM r",
        "ve3_union_cells": f"WITH {covered} SELECT DISTINCT tile, row, col FROM cv",
        "ve5_subtract_cells": f"WITH {covered} SELECT tile, row, col, poly_id FROM cv WHERE poly_id % 2 = 0 AND (tile, row, col) NOT IN (SELECT (tile, row, col) FROM cv WHERE poly_id % 2 = 1)",
        "ve10_alignment": f"WITH {covered} SELECT CAST(count(*) AS DOUBLE) AS sum_area, CAST(count(DISTINCT (tile, row, col)) AS DOUBLE) AS union_area, count(*) = count(DISTINCT (tile, row, col)) AS aligned FROM cv",
        "ve11_overlaps": f"WITH {covered}, n AS (SELECT poly_id, count(*) AS n FROM cv GROUP BY poly_id), s AS (SELECT x.poly_id AS a, y.poly_id AS b, count(*) AS shared FROM cv x JOIN cv y ON x.tile = y.tile AND x.row = y.row AND x.col = y.col AND x.poly_id < y.poly_id GROUP BY ALL) SELECT a, b, shared, CASE WHEN shared = na.n THEN 'within' WHEN shared = nb.n THEN 'contains' ELSE 'overlaps' END AS kind FROM s JOIN n na ON na.poly_id = a JOIN n nb ON nb.poly_id = b",
        "ve14_resolve_overlaps": f"WITH {covered} SELECT tile, row, col, min(poly_id) AS poly_id FROM cv GROUP BY ALL",
        "ra12_touched_cells": f"WITH {CELLS}, {base.EDGES}, p AS (SELECT tile, row, col, col + 0.25 AS x, row + 0.25 AS y FROM cells), j AS (SELECT p.*, e.*, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS side FROM p CROSS JOIN edges e) SELECT tile, row, col, CAST(poly_id AS INT) AS poly_id FROM j GROUP BY tile, row, col, x, y, poly_id HAVING bool_or(x + 0.5 >= least(x1, x2) AND x - 0.5 <= greatest(x1, x2) AND y + 0.5 >= least(y1, y2) AND y - 0.5 <= greatest(y1, y2) AND abs(side) <= abs(x2 - x1) * 0.5 + abs(y2 - y1) * 0.5) OR count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1",
        "jn2_nearest_cell": f"WITH {pts}, {tiles}, m AS (SELECT id, x * 10 AS x, y * 10 AS y, t.* EXCLUDE (tile), tile FROM p JOIN tiles t ON (x * 10 - x0) / dx BETWEEN -0.5 AND cols - 0.5 AND (y * 10 - y0) / dy BETWEEN -0.5 AND rows - 0.5), c AS (SELECT id, tile, CAST(least(greatest(floor((y - y0) / dy + 0.5), 0), rows - 1) AS INT) AS r, CAST(least(greatest(floor((x - x0) / dx + 0.5), 0), cols - 1) AS INT) AS c, x, y, x0, y0, dx, dy FROM m), g AS (SELECT id, min((sqrt((x - x0 - c * dx) ** 2 + (y - y0 - r * dy) ** 2), tile, r, c)) AS m FROM c GROUP BY id) SELECT p.id, m[2] AS tile, m[3] AS row, m[4] AS col, round(m[1], 6) AS distance FROM p LEFT JOIN g USING (id)",
        "in1_nearest_by_steps": f"WITH {STATIONS}, {pts}, m AS (SELECT id, min((abs(p.x - s.x) + abs(p.y - s.y), station)) AS m FROM p CROSS JOIN stations s GROUP BY id) SELECT id, m[2] AS station, round(m[1], 6) AS distance FROM m",
        "wn12_path_lengths": "WITH p AS (SELECT l_orderkey AS path_id, l_linenumber AS seq, l_quantity AS x, l_tax * 100 AS y, l_discount * 100 AS z FROM lineitem), d AS (SELECT *, x - lag(x) OVER w AS a, y - lag(y) OVER w AS b, z - lag(z) OVER w AS c FROM p WINDOW w AS (PARTITION BY path_id ORDER BY seq, x, y, z)) SELECT path_id, seq, round(sum(coalesce(sqrt(a * a + b * b), 0)) OVER w, 6) AS length_2d, round(sum(coalesce(sqrt(a * a + b * b + c * c), 0)) OVER w, 6) AS length_3d FROM d WINDOW w AS (PARTITION BY path_id ORDER BY seq, x, y, z ROWS UNBOUNDED PRECEDING)",
        "ag6_metric_statistics": f"WITH {area} SELECT area, round(any_value(mean), 6) AS mean, round(sqrt(sum(pixels * (value - mean) ** 2) / any_value(n)), 6) AS std, round(any_value(hi), 6) AS max, round(any_value(lo), 6) AS min FROM rw JOIN st USING (area) GROUP BY area",
        "jn15_station_pixels": f"WITH {CELLS}, s AS (SELECT (tile * 1000 + row * 50 + col) % (SELECT max(user_id) + 1 FROM events) AS station, tile, row, col FROM cells) SELECT CAST(station AS BIGINT) AS station, CAST(count(*) AS INT) AS n, string_agg(tile || ':' || row || ':' || col, ',' ORDER BY tile, row, col) AS pixels FROM s GROUP BY station",
        "mo4_area_alerts": f"WITH {area}, h AS (SELECT area, ts, sum(pixels) AS pixels, string_agg(CAST(station AS VARCHAR), ',' ORDER BY station) AS stations FROM rw JOIN st USING (area) WHERE value >= round(0.75 * hi, 5) GROUP BY area, ts), w AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY area ORDER BY ts)) > 172800 THEN 1 ELSE 0 END AS w FROM h) SELECT area, ts, 'rt' || CAST(1 + sum(w) OVER (PARTITION BY area ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event, CAST(pixels AS BIGINT) AS pixels, stations FROM w",
        "it4_compatible_paths": _compatible_sql("path_id, CAST(len(valid) AS INT) AS steps, stop_reason, array_to_string(path, ',') AS cells, round(coalesce(list_sum(dev), 0), 6) AS deviation"),
        "it3_realism_scores": _compatible_sql("path_id, array_to_string(path, ',') AS cells, round(greatest(0, 90 * coalesce(list_avg(list_transform(valid, lambda v: CASE WHEN v THEN 1.0 ELSE 0.0 END)), 0) + least(coalesce(list_sum(len), 0) / 5, 10) - 2 * CASE WHEN stop_reason IN ('loop_detected', 'edge_reached') THEN 3 WHEN stop_reason = 'max_runout' THEN 1 ELSE 2 END - 5 * coalesce(list_avg(dev), 0) - least(60, greatest(0, 5 * (7 - abs(coalesce(list_avg(deg), 0)))))), 6) AS score"),
        "pf5_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        "pf7_containment": "SELECT n_nationkey AS k, r_regionkey IS NOT NULL AS found, coalesce(r_regionkey = n_regionkey, false) AS same_v FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
        "pf8_geographic": "SELECT l_returnflag, bool_and(l_extendedprice / 500 BETWEEN -180 AND 180 AND l_quantity BETWEEN -90 AND 90) AS geographic FROM lineitem GROUP BY l_returnflag",
    }
