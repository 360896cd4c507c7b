"""Scattered values on grids against the triangles of all points, and merged series."""

import datetime as dt

import numpy as np
import pytest

from scarpline.operators import merging, points, scatter

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("side", [0.15, 5.0])
def test_linear_equals_the_triangles_of_all_points(spark, side):
    rng = np.random.default_rng(4)
    x, y, v = rng.random(120), rng.random(120) ** 2, rng.random(120)
    tx, ty = rng.random(150) * 1.2 - 0.1, rng.random(150) * 1.1 - 0.05
    cells = spark.createDataFrame([(0, 0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(tx, ty))], "tile int, row int, col int, x double, y double")
    pts = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, v)] + [(None, 1.0, 1.0), (float(x[0]), float(y[0]), float(v[0]))], "px double, py double, v double")
    got = {r.col: r.value for r in scatter.scatter_to_grid(cells, pts, "linear", side).collect()}
    want = points._linear(x, y, v, tx, ty)
    assert len(got) == 150 and np.isnan(want).sum() > 10
    assert [got[i] for i in range(150)] == [None if np.isnan(w) else pytest.approx(w, abs=1e-9) for w in want]
    masked = {r.col: r.value for r in scatter.scatter_to_grid(cells, pts, "nearest", side, 0.05).collect()}
    d = np.hypot(tx[:, None] - x, ty[:, None] - y)
    assert [masked[i] for i in range(150)] == [None if d[i].min() > 0.05 else pytest.approx(v[d[i].argmin()]) for i in range(150)]


def test_too_few_points_give_nothing(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0.5, 0.5)], "tile int, row int, col int, x double, y double")
    for rows in ([], [(0.0, 0.0, 1.0)], [(0.0, 0.0, 1.0), (1.0, 1.0, 2.0), (2.0, 2.0, 3.0)]):
        pts = spark.createDataFrame(rows, "px double, py double, v double")
        assert [r.value for r in scatter.scatter_to_grid(cells, pts).collect()] == [None]


def test_regridding_takes_single_near_rows(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", at(m), float(v)) for v, m in enumerate([0, 10, 21, 38, 60, 64])] + [("b", at(5), 7.0), ("b", None, 1.0)]
    got = merging.regrid(spark.createDataFrame(rows, "station string, ts timestamp, value double")).collect()
    a = sorted((r.ts, r.value) for r in got if r.station == "a")
    assert [t for t, _ in a] == [at(4 * k) for k in range(17)]
    # 10 and 38 lie midway between two slots
    assert {t: v for t, v in a if v is not None} == {at(0): 0.0, at(20): 2.0, at(60): 4.0, at(64): 5.0}
    assert [(r.ts, r.value) for r in got if r.station == "b"] == [(at(5), 7.0)]


def test_merging_on_common_and_wide_axes(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(s, at(h), at(h + 1), -9.0 if h == 4 else float(h)) for s, a, b in (("a", 0, 6), ("b", 2, 9)) for h in range(a, b)]
    df = spark.createDataFrame(rows, "station string, start_ts timestamp, end_ts timestamp, value double")
    common = sorted(map(tuple, merging.merge_series(df, no_data=[-9.0]).select("station", "start_ts", "value").collect()), key=str)
    assert common == sorted([(s, at(h), None if h == 4 else float(h)) for s in "ab" for h in range(2, 6)], key=str)
    union = merging.merge_series(df, common=False)
    assert union.count() == 18 and union.filter("value IS NULL").count() == 5
    wide = {r.start_ts: (r.a, r.b) for r in merging.wide(union, ["a", "b"]).collect()}
    assert wide[at(1)] == (1.0, None) and wide[at(5)] == (5.0, 5.0)
    assert merging.merge_problems(df).count() == 0
    none = df.limit(0)
    assert merging.merge_series(none).count() == merging.merge_series(none, common=False).count() == merging.merge_problems(none).count() == 0
