"""Scans and splines in blocks against plain loops and dense systems."""

import datetime as dt
import random

import numpy as np
import pytest

from scarpline.operators import recurrences as rc
from scarpline.operators import timeseries

T0 = dt.datetime(2024, 1, 1)


def frame(spark, series):
    rows = [(s, T0 + dt.timedelta(hours=i), v) for s, own in series.items() for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "station string, ts timestamp, value double")


def by_station(df, column):
    out = {}
    for r in df.orderBy("station", "ts").collect():
        out.setdefault(r["station"], []).append(r[column])
    return out


def dense(values, degree):
    """Spline through (row, value) from one linear system over the coefficients of all its pieces."""
    x = [float(i) for i, v in enumerate(values) if v is not None]
    y = [v for v in values if v is not None]
    if len(x) < degree + 1:
        return values
    if degree == 3:
        knots = [x[0], *x[2:-2], x[-1]] if len(x) > 4 else [x[0], x[-1]]
    else:
        middle = [(a + b) / 2 for a, b in zip(x, x[1:])]
        knots = [x[0], *middle[1:-1], x[-1]]
    pieces, size = len(knots) - 1, degree + 1
    rows, right = [], []

    def piece(p):
        return min(max(np.searchsorted(knots, p, "right") - 1, 0), pieces - 1)

    def put(parts, value):
        row = np.zeros(pieces * size)
        for k, p, d, sign in parts:
            for j in range(d, size):
                row[k * size + j] += sign * np.prod([j - i for i in range(d)]) * (p - knots[k]) ** (j - d)
        rows.append(row)
        right.append(value)

    for p, v in zip(x, y):
        put([(piece(p), p, 0, 1)], v)
    for k in range(1, pieces):
        for d in range(degree):
            put([(k - 1, knots[k], d, 1), (k, knots[k], d, -1)], 0.0)
    c = np.linalg.solve(np.array(rows), np.array(right))
    at = lambda p: sum(c[piece(p) * size + j] * (p - knots[piece(p)]) ** j for j in range(size))
    return [v if v is not None else at(float(i)) if x[0] < i < x[-1] else None for i, v in enumerate(values)]


def gappy(pick, n, share):
    return [round(pick.uniform(-5, 5), 3) if pick.random() > share else None for _ in range(n)]


@pytest.mark.parametrize("method,degree", [("quadratic", 2), ("cubic", 3)])
@pytest.mark.parametrize("block", [3, 4096])
def test_splines_equal_dense_systems(spark, method, degree, block):
    pick = random.Random(5)
    series = {f"s{k}": gappy(pick, n, share) for k, (n, share) in enumerate([(40, 0.5), (60, 0.8), (25, 0.2), (9, 0.4), (12, 0.7)])}
    series |= {"three": [1.0, None, 4.0, None, 2.0], "four": [None, 1.0, None, 4.0, 2.0, None, None, 7.0, None], "two": [1.0, None, 3.0], "none": [None, None], "full": [1.0, 2.0, 5.0]}
    got = by_station(rc.spline_fill(frame(spark, series), method, block=block), "value")
    for s, values in series.items():
        assert got[s] == [v if v is None else pytest.approx(v, abs=1e-8) for v in dense(values, degree)], s


def loops(x, n):
    """Both averages by their definitions, one row after the other."""
    alpha, ema, last, weight = 2 / (n + 1), [], None, 1.0
    for v in x:
        if last is None:
            last = v
        else:
            weight *= 1 - alpha
            if v is not None:
                last, weight = (weight * last + alpha * v) / (weight + alpha), 1.0
        ema.append(last)
    ada = []
    for t in range(len(x)):
        own = [v for v in x[max(0, t - n + 1) : t + 1] if v is not None]
        simple = sum(own) / len(own) if own else None
        value = simple
        if t >= n and x[t] is not None and ada[-1] is not None:
            steps = [abs(x[i] - x[i - 1]) if x[i] is not None and x[i - 1] is not None else None for i in range(t - n + 1, t + 1)]
            whole = None not in steps and sum(steps) != 0
            if not whole or x[t - n] is not None:
                ratio = abs(x[t] - x[t - n]) / sum(steps) if whole else 0.0
                value = ada[-1] + (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[t] - ada[-1])
        ada.append(value)
    return ema, ada


def test_averages_equal_loops_in_any_blocks(spark):
    pick = random.Random(6)
    series = {f"s{k}": gappy(pick, 70, share) for k, share in enumerate([0.0, 0.02, 0.3, 0.9])} | {"none": [None] * 5, "one": [2.0], "flat": [1.0] * 12 + [None] * 6 + [3.0] * 12}
    df = frame(spark, series)
    for block in (4, 4096):
        ema, ada = by_station(rc.exponential(df, 5, block=block), "exponential"), by_station(rc.adaptive(df, 5, block=block), "adaptive")
        for s, x in series.items():
            want = loops(x, 5)
            near = lambda own: [v if v is None else pytest.approx(v, abs=1e-9) for v in own]
            assert ema[s] == near(want[0]) and ada[s] == near(want[1]), (s, block)


def test_long_series_take_linear_time(spark):
    pick = random.Random(7)
    df = frame(spark, {"long": gappy(pick, 100_000, 0.6)}).cache()
    df.count()
    for fill in ("linear", "cubic"):
        began = dt.datetime.now()
        assert timeseries.fill_gaps(df, fill).filter("value IS NULL").count() < 40
        assert (dt.datetime.now() - began).total_seconds() < 60, fill
    assert timeseries.exponential_and_adaptive(df, 24).filter("exponential IS NULL").count() < 40


def test_times_are_filled_between_known_ones(spark):
    at = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    rows = [("a", i, at(m)) for i, m in enumerate([None, 0, None, None, 30, None])]
    got = rc.fill_times(spark.createDataFrame(rows, "station string, i int, ts timestamp"), "i").orderBy("i").collect()
    assert [r.ts for r in got] == [at(m) for m in [None, 0, 10, 20, 30, 30]]


def test_averages_are_taken_where_the_axis_was_made(spark, monkeypatch):
    # tables of all rows of the axis were shuffled some twenty times
    monkeypatch.setattr(timeseries, "SPAN", 7, raising=False)
    pick = random.Random(8)
    rows = [(s, T0 + dt.timedelta(hours=i), round(pick.uniform(-5, 5), 3)) for s in ("a", "b", "c") for i in range(40) if pick.random() < (0.4 if s == "a" else 0.97)]
    got = timeseries.exponential_and_adaptive(timeseries.regular_axis(spark.createDataFrame(rows, "station string, ts timestamp, value double")), 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan and "Exchange" not in plan[: plan.index("Generate explode")]
    known = {(s, ts): v for s, ts, v in rows}
    first, last = min(r[1] for r in rows), max(r[1] for r in rows)
    axis = [first + dt.timedelta(hours=i) for i in range(int((last - first).total_seconds()) // 3600 + 1)]
    ema, ada = by_station(got, "exponential"), by_station(got, "adaptive")
    for s in ("a", "b", "c"):
        want = loops([known.get((s, ts)) for ts in axis], 5)
        near = lambda own: [v if v is None else pytest.approx(v, abs=1e-9) for v in own]
        assert ema[s] == near(want[0]) and ada[s] == near(want[1])


@pytest.mark.parametrize("span", [2, 4096])
def test_axis_keeps_repeats_and_drops_what_is_between_its_steps(spark, monkeypatch, span):
    monkeypatch.setattr(timeseries, "SPAN", span, raising=False)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", at(0), 1.0, "p"), ("a", at(120), 2.0, "q"), ("a", at(120), 3.0, "r"), ("a", at(90), 4.0, "s"), ("b", at(240), None, "t"), (None, at(60), 5.0, "u"), ("a", None, 6.0, "v")]
    got = timeseries.regular_axis(spark.createDataFrame(rows, "station string, ts timestamp, value double, note string"))
    assert got.columns == ["station", "ts", "value", "note"]
    want = [(s, at(60 * h), None, None) for s in ("a", "b", None) for h in range(5)]
    want = [r for r in want if r[:2] not in {("a", at(0)), ("a", at(120)), ("b", at(240))}] + [rows[0], rows[1], rows[2], rows[4]]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
