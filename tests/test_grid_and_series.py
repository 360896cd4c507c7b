import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from scarpline.functions import scalars
from scarpline.operators import grid, model, neighbours, paths, timeseries

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, step=3600):
    return spark.createDataFrame([("A", T0 + dt.timedelta(seconds=i * step), v) for i, v in enumerate(values)], "station string, ts timestamp, value double")


def values(df, *columns):
    rows = df.orderBy("ts").select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]


def plane(spark, n=5):
    return spark.createDataFrame([(0, r, c, float(3 * c + 4 * r)) for r in range(n) for c in range(n)], "tile int, row int, col int, z double")


def test_plane_has_constant_slope_and_no_curvature(spark):
    out = grid.curvatures(grid.slope_aspect(plane(spark))).collect()
    assert {(r["gx"], r["gy"]) for r in out} == {(3.0, 4.0)}
    assert all(r["slope"] == pytest.approx(math.degrees(math.atan(5))) for r in out)
    assert all(r["aspect"] == pytest.approx((math.degrees(math.atan2(-4, 3)) + 360) % 360) for r in out)
    assert all(abs(r[k]) < 1e-9 for r in out for k in ("profile", "planform", "twisting"))


def test_no_data_is_null_for_the_cell_and_its_neighbours(spark):
    g = grid.gradients(plane(spark).withColumn("z", F.when((F.col("row") != 2) | (F.col("col") != 2), F.col("z")))).filter("row = 2 AND col IN (1, 3)").collect()
    assert [r["gx"] for r in g] == [None, None]


def test_exponential_average_ages_over_gaps(spark):
    out = timeseries.exponential_and_adaptive(series(spark, [1.0, None, None, 4.0, 2.0]), 3)
    assert values(out, "exponential") == pytest.approx([1, 1, 1, 3.4, 2.7])


@pytest.mark.parametrize(("method", "expected"), [("zero", [0, 1, 0, 0, 4, 0]), ("previous", [None, 1, 1, 1, 4, 4]), ("next", [1, 1, 4, 4, 4, None]), ("mean", [1, 1, 2.5, 2.5, 4, None]), ("linear", [None, 1, 2, 3, 4, 4]), ("nearest", [None, 1, 1, 4, 4, None])])
def test_gap_filling(spark, method, expected):
    assert values(timeseries.fill_gaps(series(spark, [None, 1.0, None, None, 4.0, None]), method), "value") == expected


def test_resample_is_anchored_at_the_end(spark):
    out = timeseries.resample(series(spark, [1.0] * 7), 3).orderBy("end_ts").collect()
    assert [r["value"] for r in out] == [1, 3, 3]


def test_sessions_merge_an_equal_gap(spark):
    out = timeseries.sessions(spark.createDataFrame([("A", T0 + dt.timedelta(days=d), 1.0) for d in (0, 5, 11)], "station string, ts timestamp, value double"))
    assert values(out, "event") == [1, 1, 2]


def test_threshold_drops_what_lies_beyond_the_fences(spark):
    out = timeseries.default_threshold(series(spark, [float(v) for v in [*range(1, 101), 10000]])).collect()
    assert out[0]["threshold"] == pytest.approx(98.02)


def test_empty_series_give_empty_results(spark):
    none = series(spark, [])
    assert timeseries.regular_axis(none).count() == 0
    assert timeseries.statistics(none).count() == 0
    assert timeseries.moving_averages(none, 3).count() == 0


def test_idw_and_nearest_fill(spark):
    rows = [("P", T0, None), ("A", T0, 1.0), ("B", T0, 4.0)]
    obs = spark.createDataFrame(rows, "station string, ts timestamp, value double")
    dist = neighbours.distance_matrix(spark.createDataFrame([("P", 0.0, 0.0), ("A", 1.0, 0.0), ("B", 0.0, 2.0)], "station string, x double, y double"))
    idw = neighbours.fill_from_stations(obs, dist, 5.0, "idw").filter("station = 'P'").first()
    near = neighbours.fill_from_stations(obs, dist, 5.0).filter("station = 'P'").first()
    assert idw["value"] == pytest.approx(1.6) and idw["source"] == "idw_[A, B]"
    assert (near["value"], near["source"]) == (1.0, "nearest_[A]")


def test_nearest_is_the_same_whatever_the_squares(spark):
    pts = spark.createDataFrame([(i, i * 0.37 % 5, i * 0.91 % 5) for i in range(60)], "id int, x double, y double")
    refs = spark.createDataFrame([(i, i * 1.3 % 5, i * 2.9 % 5) for i in range(9)], "ref int, rx double, ry double")
    found = [{(r["id"], r["ref"]) for r in neighbours.nearest(pts, refs, c).collect()} for c in (0.2, 1.0, 20.0)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_the_first_polygon_paints(spark):
    burns = spark.createDataFrame([(0, 1, 1, 0, 10.0), (0, 1, 1, 1, 20.0)], "tile int, row int, col int, priority int, value double")
    out = grid.paint(plane(spark), burns, -1.0)
    assert out.filter("row = 1 AND col = 1").first()["value"] == 10.0 and out.filter("value = -1").count() == 24


def test_staircase_path_runs_to_the_edge(spark):
    cells = spark.createDataFrame([(0, r, c, -20.0 * c + (0.0 if r == 2 else 500.0)) for r in range(5) for c in range(8)], "tile int, row int, col int, z double")
    out = paths.d8_paths(cells, spark.createDataFrame([(1, 0, 2, 1)], "path_id int, tile int, row int, col int")).first()
    assert out["stop_reason"] == "edge_reached" and [c["col"] for c in out["cells"]] == [1, 2, 3, 4, 5, 6, 7]


def test_plateau_path_stops_after_one_step_east(spark):
    flat = spark.createDataFrame([(0, r, c, 1.0) for r in range(9) for c in range(9)], "tile int, row int, col int, z double")
    out = paths.d8_paths(flat, spark.createDataFrame([(1, 0, 4, 4)], "path_id int, tile int, row int, col int")).first()
    assert out["stop_reason"] == "invalid_steps_tolerance_reached" and [c["col"] for c in out["cells"]] == [4, 5]


def test_separate_paths_skip_what_overlaps(spark):
    rows = [("s", 1, 9.0, [0, 1, 2, 3]), ("s", 2, 8.0, [0, 1, 2, 3, 4]), ("s", 3, 7.0, [0, 7, 8])]
    out = paths.separate_paths(spark.createDataFrame(rows, "start string, path_id int, score double, cells array<int>"), 2).orderBy("rank").collect()
    assert [r["path_id"] for r in out] == [1, 3]


def test_dry_slopes_keep_their_factor(spark):
    rain = spark.createDataFrame([("A", 0.01, T0 + dt.timedelta(days=i), T0 + dt.timedelta(days=i + 1), 0.0) for i in range(40)], "station string, kt double, start_ts timestamp, end_ts timestamp, rain double")
    out = model.residual_rain(rain).orderBy("end_ts").collect()
    assert [r["residual"] for r in out] == [None] * 29 + [0.0] * 11


def test_utm_easting_and_northing(spark):
    row = spark.range(1).select(*scalars.to_utm(F.lit(9.0), F.lit(45.0), F.lit(32632))).first()
    assert row[0] == pytest.approx(500000.0, abs=1e-3) and row[1] == pytest.approx(4982950.40, abs=0.05)


def test_ranges_treat_missing_values_as_outside(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (5.0,)], "x double")
    assert [r[0] for r in df.select(scalars.in_range(F.col("x"), 0, 5, False)).collect()] == [True, False, False, False]
    with pytest.raises(ValueError):
        scalars.in_range(F.col("x"), 2, 1)
