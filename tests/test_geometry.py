import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.operators import alerts, grid, paths, points, polygons

RINGS = "poly_id long, part int, hole boolean, ring array<struct<x:double,y:double>>"


def rings(spark, *rows):
    return spark.createDataFrame([(k, p, h, [(float(x), float(y)) for x, y in r]) for k, p, h, r in rows], RINGS)


def plain_cells(spark, n=6, z=lambda r, c: float(r * c)):
    return spark.createDataFrame([(0, r, c, z(r, c), c + 0.5, r + 0.5) for r in range(n) for c in range(n)], "tile int, row int, col int, z double, x double, y double")


def test_measures_leave_holes_out(spark):
    got = polygons.measures(rings(spark, (1, 0, False, [(0, 0), (4, 0), (4, 4), (0, 4)]), (1, 0, True, [(1, 1), (1, 2), (2, 2), (2, 1)]))).first()
    assert (got["area"], got["length"]) == (15.0, 20.0) and (got["x_min"], got["y_max"]) == (0.0, 4.0)


def test_shapes_and_clean_rings(spark):
    one = spark.range(1).select(polygons.circle(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("c"), polygons.square(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("s"))
    area = one.select(polygons.ring_area(F.col("c")), polygons.ring_area(F.col("s"))).first()
    assert area[0] == pytest.approx(np.pi * 9, rel=2e-3) and area[1] == 4.0
    dirty = rings(spark, (1, 0, False, [(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)]), (2, 0, False, [(0, 0), (1, 1), (0, 0)]), (3, 0, False, []))
    got = {r[0]: r[1] for r in dirty.select("poly_id", F.size(polygons.clean_ring(F.col("ring")))).collect()}
    assert got == {1: 3, 2: 0, 3: 0}
    assert dirty.filter("poly_id = 1").select(polygons.round_ring(F.col("ring"), 0.4)).first()[0][1]["x"] == pytest.approx(0.8)


def test_clipping_to_a_box(spark):
    own = rings(spark, (1, 0, False, [(-2, 1), (2, -3), (6, 1), (2, 5)]), (2, 0, False, [(9, 9), (10, 9), (10, 10)]), (3, 0, False, [(1, 1), (2, 1), (2, 2)]))
    got = {r["poly_id"]: r["area"] for r in polygons.measures(polygons.clip_to_box(own, 0, 4, 0, 4)).collect()}
    # of the diamond |x - 2| + |y - 1| <= 4 inside of the box, by fine sampling
    side = (np.arange(4000) + 0.5) / 1000
    want = (np.abs(side[:, None] - 2) + np.abs(side - 1) <= 4).mean() * 16
    assert got[1] == pytest.approx(want, abs=1e-2) and got[3] == 0.5 and 2 not in got


def test_sets_of_cells(spark):
    cells = plain_cells(spark)
    own = rings(spark, (1, 0, False, [(0, 0), (3, 0), (3, 3), (0, 3)]), (2, 0, False, [(2, 2), (5, 2), (5, 5), (2, 5)]), (3, 0, False, [(0, 0), (1, 0), (1, 1), (0, 1)]))
    covered = grid.cells_in_polygons(cells, polygons.edges(own))
    assert covered.count() == 19 and polygons.union_cells(covered).count() == 17
    assert sorted(map(tuple, polygons.overlaps(covered).collect())) == [(1, 2, 1, "overlaps"), (1, 3, 1, "contains")]
    resolved = polygons.resolve_overlaps(covered.withColumn("priority", -F.col("poly_id"))).groupBy("poly_id").count().collect()
    assert dict(map(tuple, resolved)) == {1: 7, 2: 9, 3: 1}
    assert tuple(polygons.alignment(covered).first()) == (19.0, 17.0, False)
    assert polygons.subtract_cells(covered.filter("poly_id = 1"), covered.filter("poly_id = 2")).count() == 8
    assert polygons.intersect_cells(covered.filter("poly_id = 1"), covered.filter("poly_id = 2")).count() == 1


def test_touched_cells_hold_any_part(spark):
    cells = plain_cells(spark)
    sliver = rings(spark, (1, 0, False, [(0.6, 0.56), (3.4, 1.36), (3.4, 1.41), (0.6, 0.61)]))
    got = {(r["row"], r["col"]) for r in grid.cells_touched(cells, polygons.edges(sliver)).collect()}
    on_way = {(int(0.56 + t * 0.8 + d), int(0.6 + t * 2.8)) for t in np.linspace(0, 1, 2001) for d in (0, 0.05)}
    assert got == on_way


def test_snapping_moves_vertices_to_the_nearest_target(spark):
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 4.0, 4.0)], "ref long, rx double, ry double")
    got = polygons.snap_vertices(rings(spark, (1, 0, False, [(0.2, 0.1), (3.9, -0.3), (3.5, 9.0)])), targets, 1.0).first()
    assert [(p["x"], p["y"]) for p in got["ring"]] == [(0, 0), (4, 0), (4, 4)]


def test_nearest_cells_over_tiles(spark):
    tiles = spark.createDataFrame([(0, 0.5, 9.5, 1.0, -1.0, 10, 10), (1, 10.25, 9.75, 0.5, -0.5, 20, 20)], "tile int, x0 double, y0 double, dx double, dy double, rows int, cols int")
    own = spark.createDataFrame([(1, 0.1, 9.9), (2, 10.0, 5.1), (3, 50.0, 1.0), (4, 15.3, 2.2), (5, None, 1.0)], "id long, x double, y double")
    got = {r["id"]: (r["tile"], r["row"], r["col"]) for r in points.nearest_cell(own, tiles).collect()}
    assert got == {1: (0, 0, 0), 2: (1, 9, 0), 3: (None, None, None), 4: (1, 15, 10), 5: (None, None, None)}
    made = points.grid_from_box(spark, 0.0, 3.0, 0.0, 2.0, 1.0)
    assert made.count() == 6 and tuple(points.bounding_box(made).first()) == (0, 0.0, 3.0, 0.0, 2.0)


def test_interpolation(spark):
    spots = [(k, float(x), float(y)) for k, (x, y) in enumerate(itertools.product((0, 1, 3), (0, 2, 3)))] + [(90, 1.2, 1.1), (91, 8.0, 8.0)]
    stations = spark.createDataFrame(spots, "station long, x double, y double")
    rows = [(k, "2024-01-01", 2 * x - y + 1 if k < 90 else None) for k, x, y in spots] + [(k, "2024-01-02", None) for k, _, _ in spots]
    series = spark.createDataFrame(rows, "station long, ts string, value double")
    got = {(r["station"], r["ts"]): r["value"] for r in points.interpolate(series, stations).collect()}
    assert got[90, "2024-01-01"] == pytest.approx(2.3) and got[91, "2024-01-01"] is None and got[90, "2024-01-02"] is None
    rbf = {(r["station"], r["ts"]): r["value"] for r in points.interpolate(series, stations, "rbf").collect()}
    assert rbf[90, "2024-01-01"] == pytest.approx(2.3, abs=0.3) and rbf[0, "2024-01-01"] == 1.0
    near = points.nearest_by_steps(spark.createDataFrame([(1, 0.9, 0.2)], "id long, x double, y double"), stations).first()
    assert near["station"] == 3


def all_paths(z, start, steps, least, tolerance):
    """Every simple path, by a plain search."""
    d8 = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
    out, stack = [], [([start], 0)]
    while stack:
        path, flat = stack.pop()
        r, c = path[-1]
        if len(path) - 1 == steps:
            out.append((tuple(path), "max_runout"))
            continue
        around = [(r + a, c + b, np.hypot(a, b)) for a, b in d8]
        if any(not (0 <= a < len(z) and 0 <= b < len(z)) for a, b, _ in around):
            out.append((tuple(path), "edge_reached"))
            continue
        slopes = [(a, b, (z[a][b] - z[r][c]) / n) for a, b, n in around]
        good = [s for s in slopes if s[2] <= -least]
        low = [s for s in slopes if -least < s[2] <= 0]
        if not good and not low:
            out.append((tuple(path), "greater_than_tolerance_opposite_flow"))
        elif not good and flat == tolerance:
            out.append((tuple(path), "invalid_steps_tolerance_reached"))
        else:
            for s, now in [(s, 0) for s in good] + [(s, flat + 1) for s in low]:
                if (s[0], s[1]) not in path and now <= tolerance:
                    stack.append((path + [(s[0], s[1])], now))
    return sorted(out)


def test_compatible_paths_equal_a_plain_search(spark):
    rnd = np.random.default_rng(5)
    z = rnd.integers(0, 4, (7, 7)).astype(float).tolist()
    cells = plain_cells(spark, 7, lambda r, c: z[r][c])
    starts = spark.createDataFrame([(1, 0, 3, 3)], "path_id long, tile int, row int, col int")
    got = paths.compatible_paths(cells, starts, max_steps=4).collect()
    assert sorted((tuple((c["row"], c["col"]) for c in r["cells"]), r["stop_reason"]) for r in got) == all_paths(z, (3, 3), 4, np.tan(np.radians(7)), 1)
    assert all(len(r["validity"]) == len(r["deviation"]) == r["steps"] for r in got)
    few = paths.compatible_paths(cells, starts, max_steps=4, maximum_paths=3)
    assert few.filter("stop_reason = 'max_paths'").count() > 0


def test_gradient_walk_goes_down_a_plane(spark):
    cells = plain_cells(spark, 20, lambda r, c: -0.2 * c)
    starts = spark.createDataFrame([(1, 0, 10, 4), (2, 0, 0, 0)], "path_id long, tile int, row int, col int")
    got = {r["path_id"]: r for r in paths.gradient_paths(cells, starts, max_steps=30).collect()}
    assert [c["col"] for c in got[1]["cells"]][:3] == [4, 6, 8] and {c["row"] for c in got[1]["cells"]} == {10}
    assert got[1]["stop_reason"] == "edge_reached" and max(got[1]["deviation"]) < 1e-9 and all(got[1]["validity"])
    assert (got[2]["steps"], got[2]["stop_reason"]) == (0, "edge_reached")


def test_alerts_from_areas_to_paths(spark):
    walks = spark.createDataFrame([("a", 7, 0, 9.0, [(0, 0), (0, 1)]), ("b", 7, 0, 8.0, [(5, 5)]), ("c", 7, 0, 10.0, [(0, 1)])], "path_id string, start long, tile int, score double, cells array<struct<row:int,col:int>>")
    areas = alerts.attention_areas(walks)
    assert areas.count() == 3
    pixels = areas.withColumn("station", F.when(F.col("row") == 0, "S").otherwise("T"))
    assert {r["station"]: len(r["pixels"]) for r in alerts.station_pixels(pixels).collect()} == {"S": 2, "T": 1}
    series = spark.createDataFrame([("S", "2024-01-01", 5.0), ("S", "2024-01-03", 6.0), ("S", "2024-01-20", 7.0), ("T", "2024-01-01", 1.0), ("T", "2024-01-02", None)], "station string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = alerts.pixel_series(pixels, series)
    stats = alerts.metric_statistics(rows)
    values = [5, 5, 6, 6, 7, 7, 1]
    got = stats.first()
    assert (got["mean"], got["std"], got["max"], got["min"]) == pytest.approx((np.mean(values), np.std(values), 7, 1))
    found = alerts.alert_times(rows, alerts.thresholds(stats, value=5.0)).orderBy("ts")
    assert [(r["event"], r["stations"], r["pixels"]) for r in found.collect()] == [("rt1", ["S"], 2), ("rt1", ["S"], 2), ("rt2", ["S"], 2)]
    active = alerts.activated_pixels(found, pixels)
    best = alerts.critical_paths(active, walks, 1).orderBy("event").collect()
    assert [(r["event"], r["path_id"]) for r in best] == [("rt1", "c"), ("rt2", "c")]
    assert alerts.thresholds(stats, mode="max").first()["threshold"] == 5.25


def test_safety_of_pixels_falls_with_rain(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0, "S", 30.0, None), (1, 0, 0, 1, "S", -9999.0, 25.0)], "area long, tile int, row int, col int, station string, slope double, phi double")
    rain = spark.sql("SELECT 'S' AS station, timestampadd(DAY, id, timestamp '2024-01-01') AS start_ts, timestampadd(DAY, id + 1, timestamp '2024-01-01') AS end_ts, IF(id < 5, 0.0, 40.0D) AS rain FROM range(12)")
    got = {(r["col"], r["end_ts"].day): r["fs"] for r in alerts.safety_factors(pixels, rain, 3).collect()}
    assert got[0, 3] is None and got[0, 4] > got[0, 12] and got[1, 12] == float("inf")


def test_path_lengths(spark):
    own = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 4.0, 0.0), (1, 2, 3.0, 4.0, 2.0)], "path_id long, seq int, x double, y double, z double")
    assert [(r["length_2d"], r["length_3d"]) for r in polygons.path_lengths(own).orderBy("seq").collect()] == [(0, 0), (5, 5), (5, 7)]
