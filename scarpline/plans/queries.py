"""One registered query per operator family over the star-schema tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.functions import scalars
from scarpline.operators import grid, model, neighbours, paths, recurrences, timeseries
from scarpline.plans.fixtures import CELLS, FULL, OBS, STATIONS, cells, observations, read, stations

HOUR = 3600


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that sums in another order compare as equal; -0.0 becomes 0.0."""
    return df.withColumns({c: steady(F.col(c), digits) for c in columns})


#: Added before rounding, here and in the SQL: means of decimal numbers often lie midway between two roundings.
NUDGE = "1e-10"


def steady(x, digits: int = 6):
    return F.round(F.lit(float(NUDGE)) + x, digits) + F.lit(0.0)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.regular_axis(observations(spark, sf_dir), HOUR)


def zero_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.fill_gaps(series(spark, sf_dir), "zero")


def threshold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hours exceed the station's own trimmed 0.98 quantile of the 6-hour average, grouped into events."""
    smooth = timeseries.moving_averages(zero_series(spark, sf_dir), 6).select("station", "ts", steady(F.col("simple")).alias("value"))
    limits = timeseries.default_threshold(smooth, 0.98).withColumn("threshold", steady(F.col("threshold"), 5))
    return timeseries.threshold_events(smooth, limits, tolerance_seconds=2 * 86400)


def _gap_fill(method: str):
    return lambda s, d: rounded(timeseries.fill_gaps(series(s, d), method).select("station", "ts", "value"), "value")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every fourth has lost its time, in the order of their numbers."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "event_id", F.when(F.pmod("event_id", F.lit(4)) != 1, F.col("ts")).alias("ts"))
    return recurrences.fill_times(e, "event_id").select("station", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("millis"))


def _spline_sql(method: str) -> str:
    """The tridiagonal system of a spline, eliminated row by row and solved backwards."""
    if method == "cubic":
        system = """SELECT station, k, 1 AS lo, n - 2 AS hi, CASE WHEN k = 1 THEN 0 WHEN k = n - 2 THEN g - h * h / g ELSE g END AS a, 2 * (g + h) + CASE WHEN k = 1 THEN g * (g + h) / h ELSE 0 END + CASE WHEN k = n - 2 THEN h * (g + h) / g ELSE 0 END AS b,
  CASE WHEN k = n - 2 THEN 0 WHEN k = 1 THEN h - g * g / h ELSE h END AS c, 6 * (dy - ey) AS d FROM k1 WHERE n >= 4 AND k BETWEEN 1 AND n - 2"""
        curve = """e0 AS (SELECT k1.*, m, lead(m) OVER w AS m1, lead(m, 2) OVER w AS m2, lag(m) OVER w AS b1, lag(m, 2) OVER w AS b2, lead(h) OVER w AS hh, lag(g) OVER w AS gg FROM k1 LEFT JOIN bw USING (station, k) WHERE n >= 4 WINDOW w AS (PARTITION BY station ORDER BY k)),
e1 AS (SELECT *, CASE WHEN k = 0 THEN ((h + hh) * m1 - h * m2) / hh WHEN k = n - 1 THEN ((g + gg) * b1 - g * b2) / gg ELSE m END AS mm FROM e0),
e2 AS (SELECT *, lead(mm) OVER (PARTITION BY station ORDER BY k) AS nx FROM e1),
v AS (SELECT s.station, s.i, y + (s.i - x) * (dy - h * (2 * mm + nx) / 6) + (s.i - x) ** 2 * mm / 2 + (s.i - x) ** 3 * (nx - mm) / (6 * h) AS v FROM s JOIN e2 ON e2.station = s.station AND s.value IS NULL AND s.i > x AND s.i < x + h)"""
    else:
        system = """SELECT station, k, 0 AS lo, n - 2 AS hi, CASE WHEN k IN (0, n - 2) THEN 0 ELSE h / (g + h) END AS a, CASE WHEN k IN (0, n - 2) THEN 1 ELSE g / (g + h) + 2 + nh / (h + nh) END AS b, CASE WHEN k IN (0, n - 2) THEN 0 ELSE h / (h + nh) END AS c, CASE WHEN k IN (0, n - 2) THEN dy ELSE 4 * dy END AS d FROM k1 WHERE n >= 3 AND k <= n - 2"""
        curve = """e0 AS (SELECT k1.*, m, lag(m) OVER (PARTITION BY station ORDER BY k) AS b1 FROM k1 LEFT JOIN bw USING (station, k) WHERE n >= 3),
e1 AS (SELECT station, k, x AS o, y AS c0, (b1 * h + m * g) / (g + h) AS c1, (m - b1) / (g + h) AS c2 FROM e0 WHERE k BETWEEN 1 AND n - 2),
gap AS (SELECT s.station, s.i, least(greatest(CASE WHEN s.i <= x + h / 2.0 THEN k ELSE k + 1 END, 1), n - 2) AS k FROM s JOIN k1 ON k1.station = s.station AND s.value IS NULL AND s.i > x AND s.i < x + h WHERE n >= 3),
v AS (SELECT station, i, c0 + (i - o) * c1 + (i - o) ** 2 * c2 AS v FROM gap JOIN e1 USING (station, k))"""
    return f"""WITH RECURSIVE {FULL}, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS i FROM series),
k0 AS (SELECT station, CAST(i AS DOUBLE) AS x, value AS y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY station) AS n, CAST(lead(i) OVER w - i AS DOUBLE) AS h, (lead(value) OVER w - value) / (lead(i) OVER w - i) AS dy FROM s WHERE value IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY i)),
k1 AS MATERIALIZED (SELECT *, lag(h) OVER w AS g, lead(h) OVER w AS nh, lag(dy) OVER w AS ey FROM k0 WINDOW w AS (PARTITION BY station ORDER BY k)),
sys AS MATERIALIZED ({system}),
fw AS (SELECT station, k, hi, c / b AS cp, d / b AS dp FROM sys WHERE k = lo UNION ALL SELECT q.station, q.k, q.hi, q.c / (q.b - q.a * f.cp), (q.d - q.a * f.dp) / (q.b - q.a * f.cp) FROM fw f JOIN sys q ON q.station = f.station AND q.k = f.k + 1),
bw AS (SELECT station, k, dp AS m FROM fw WHERE k = hi UNION ALL SELECT f.station, f.k, f.dp - f.cp * b.m FROM bw b JOIN fw f ON f.station = b.station AND f.k = b.k - 1),
{curve}
SELECT station, ts, round(coalesce(value, v), 6) + 0.0 AS value FROM s LEFT JOIN v USING (station, i)"""


def _gap_sql(expression: str) -> str:
    return f"""WITH {FULL}, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS i FROM series),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS p, first_value(value IGNORE NULLS) OVER a AS nx,
  last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM n
  WINDOW b AS (PARTITION BY station ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, ts, round({expression}, 6) + 0.0 AS value FROM f"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.pmod("c_custkey", F.lit(37)) * 0.006).alias("x"), (F.pmod("c_custkey", F.lit(29)) * 0.005).alias("y"))


def _burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    box = cells(spark, sf_dir).select("tile", "row", "col").join(F.broadcast(n), F.col("row").between(F.pmod("k", F.lit(5)) * 4, F.pmod("k", F.lit(5)) * 4 + 5) & F.col("col").between(F.floor(F.col("k") / 5) * 9, F.floor(F.col("k") / 5) * 9 + 11))
    return box.select("tile", "row", "col", F.col("k").alias("priority"), (F.col("k") * 1.5).alias("value"))


BURNS = f"{CELLS}, burns AS (SELECT tile, row, col, n_nationkey AS k FROM cells JOIN nation ON row BETWEEN (n_nationkey % 5) * 4 AND (n_nationkey % 5) * 4 + 5 AND col BETWEEN (n_nationkey // 5) * 9 AND (n_nationkey // 5) * 9 + 11)"


def _edges(spark: SparkSession) -> DataFrame:
    rings = {1: [(3, 2), (20, 4), (15, 14), (5, 11)], 2: [(10, 1), (30, 9), (22, 18), (12, 12)], 3: [(35.5, 3), (48.5, 3), (48.5, 16), (35.5, 16)]}
    rows = [(k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, r in rings.items() for a, b in zip(r, r[1:] + r[:1])]
    return spark.createDataFrame(rows, "poly_id int, x1 double, y1 double, x2 double, y2 double")


EDGES = "edges(poly_id, x1, y1, x2, y2) AS (VALUES (1,3.0,2.0,20.0,4.0),(1,20,4,15,14),(1,15,14,5,11),(1,5,11,3,2),(2,10,1,30,9),(2,30,9,22,18),(2,22,18,12,12),(2,12,12,10,1),(3,35.5,3,48.5,3),(3,48.5,3,48.5,16),(3,48.5,16,35.5,16),(3,35.5,16,35.5,3))"


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumns({"x": F.col("col") + 0.25, "y": F.col("row") + 0.25})


def _rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("station"), F.date_trunc("day", "ts").alias("start_ts")).agg((F.sum("value") / 1000).alias("rain"))
    return daily.withColumn("end_ts", F.col("start_ts") + F.expr("INTERVAL 1 DAY")).withColumn("kt", F.lit(0.01))


def slip_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = model.residual_rain(_rain(spark, sf_dir), window_days=5)
    m = model.saturation_ratio(F.col("residual"), F.lit(1.0), F.lit(0.3))
    fs = model.factor_of_safety(F.lit(30.0), m, F.lit(2.7), F.lit(5.0), F.lit(0.0), F.lit(20.0), F.lit(80.0), F.lit(0.3))
    return rounded(r.select("station", "end_ts", "residual", fs.alias("fs")), "residual", "fs", digits=9)


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select((F.col("tile") * 100000 + F.col("row") * 1000 + F.col("col")).alias("path_id"), "tile", "row", "col")


def flow_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.d8_paths(cells(spark, sf_dir), _starts(spark, sf_dir))
    return found.select("path_id", "steps", "stop_reason", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["row"], c["col"])), ",").alias("cells"))


D8_ROWS = "d8(dir, dr, dc) AS (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1),(4,0,-1),(5,-1,-1),(6,-1,0),(7,-1,1))"
NEIGHBOURS = f"{CELLS}, {D8_ROWS}, nb AS (SELECT a.tile, a.row, a.col, dir, b.row AS n_row, b.col AS n_col, b.z - a.z AS dz, sqrt(dr * dr + dc * dc) AS length, (b.z - a.z) / sqrt(dr * dr + dc * dc) AS slope FROM cells a CROSS JOIN d8 JOIN cells b ON b.tile = a.tile AND b.row = a.row + dr AND b.col = a.col + dc)"

GRADIENTS = """g0 AS (SELECT *, lag({z}) OVER c AS pl, lead({z}) OVER c AS nl, lag({z}) OVER r AS pu, lead({z}) OVER r AS nu FROM {of} WINDOW c AS (PARTITION BY tile, row ORDER BY col), r AS (PARTITION BY tile, col ORDER BY row))"""
GX = "CASE WHEN pl IS NOT NULL AND nl IS NOT NULL THEN (nl - pl) / 2 WHEN nl IS NOT NULL THEN nl - {z} WHEN pl IS NOT NULL THEN {z} - pl END"
GY = "CASE WHEN pu IS NOT NULL AND nu IS NOT NULL THEN (nu - pu) / 2 WHEN nu IS NOT NULL THEN nu - {z} WHEN pu IS NOT NULL THEN {z} - pu END"


def _grad(of: str, z: str, to: str, gx: str, gy: str) -> str:
    """A CTE `to` with the gradients gx, gy of z over the CTE `of`."""
    step = GRADIENTS.format(z=z, of=of).replace("g0", f"{to}0")
    return f"{step}, {to} AS (SELECT * EXCLUDE (pl, nl, pu, nu), {GX.format(z=z)} AS {gx}, {GY.format(z=z)} AS {gy} FROM {to}0)"


SLOPES = f"{CELLS}, {_grad('cells', 'z', 'g', 'gx', 'gy')}"
CURVES = f"{SLOPES}, {_grad('g', 'gx', 'h', 'r', 's')}, {_grad('h', 'gy', 'k', 'unused', 't')}"
FULLZ = FULL + ", zs AS (SELECT station, ts, coalesce(value, 0.0) AS value FROM series)"
FRAME = "PARTITION BY station ORDER BY ts ROWS BETWEEN"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scarpline.plans import areas, merges, rasters, records, shapes

    obs = observations
    return areas.queries() | records.queries() | shapes.queries() | rasters.queries() | merges.queries() | {
        "mo4_threshold_events": threshold_events,
        "pf1_range_mask": lambda s, d: read(s, d, "orders").select("o_orderkey", scalars.in_range(F.col("o_totalprice"), 1000, 200000).alias("inside"), F.round(scalars.filter_numeric(F.col("o_totalprice"), 50000, None, False, -1.0), 4).alias("kept")),
        "pf3_no_data": lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.drop_no_data(F.col("l_quantity"), [1.0, 50.0]).alias("quantity")),
        "pf13_clean_names": lambda s, d: read(s, d, "supplier").select("s_suppkey", scalars.clean_station_name(F.concat(F.lit(" 'A:/"), F.col("s_name"), F.lit("?*_ "))).alias("name")),
        "pf16_replace_values": lambda s, d: read(s, d, "part").select("p_partkey", scalars.replace_values(F.col("p_size"), [1, 2, 3], [2, 3, 4]).alias("size")),
        "wn13_round_minute": lambda s, d: read(s, d, "events").select("event_id", scalars.round_minute(F.col("ts")).alias("ts")),
        "sc_delta_strings": lambda s, d: read(s, d, "orders").select("o_orderkey", scalars.delta_to_string(F.col("o_orderkey") * 977).alias("delta")),
        "ag1_statistics": lambda s, d: rounded(timeseries.statistics(zero_series(s, d), (0.8, 0.9), 0.0), "mean", "std", "min", "max", "median", "mode", "q1", "q2"),
        "ag2_noise": lambda s, d: rounded(timeseries.noise(zero_series(s, d), 0.8), "mean", "max"),
        "ag3_resample": lambda s, d: rounded(timeseries.resample(series(s, d), 7), "value"),
        "ag7_default_threshold": lambda s, d: rounded(timeseries.default_threshold(obs(s, d)), "threshold"),
        "ag8_mean_step": lambda s, d: rounded(timeseries.mean_step(obs(s, d)), "mean_step"),
        "wn_moving_averages": lambda s, d: rounded(timeseries.moving_averages(series(s, d), 24, 0.0, 400.0).select("station", "ts", "valid", "simple", "cumulative", "weighted"), "simple", "cumulative", "weighted"),
        "wn6_hull": lambda s, d: rounded(timeseries.moving_averages(series(s, d), 9).select("station", "ts", "hull"), "hull"),
        "wn3_wn7_recurrences": lambda s, d: rounded(timeseries.exponential_and_adaptive(series(s, d), 24).select("station", "ts", "exponential", "adaptive"), "exponential", "adaptive"),
        "wn9_fill_zero": _gap_fill("zero"),
        "wn9_fill_previous": _gap_fill("previous"),
        "wn9_fill_next": _gap_fill("next"),
        "wn9_fill_mean": _gap_fill("mean"),
        "wn9_fill_linear": _gap_fill("linear"),
        "wn9_fill_nearest": _gap_fill("nearest"),
        "wn9_fill_quadratic": _gap_fill("quadratic"),
        "wn9_fill_cubic": _gap_fill("cubic"),
        "wn14_fill_times": _times,
        "wn10_sessions": lambda s, d: timeseries.sessions(obs(s, d).filter("value > 250"), 6 * HOUR).select("station", "ts", "event"),
        "jn1_nearest_station": lambda s, d: rounded(neighbours.nearest(_points(s, d), stations(s, d).select(F.col("station").alias("ref"), F.col("x").alias("rx"), F.col("y").alias("ry")), 0.03), "distance"),
        "jn5_distances": lambda s, d: rounded(neighbours.distances_within(stations(s, d), 0.3), "distance"),
        "ts3_fill_nearest": lambda s, d: rounded(neighbours.fill_from_stations(series(s, d), neighbours.distances_within(stations(s, d), 0.12), 0.12), "value"),
        "in5_fill_idw": lambda s, d: rounded(neighbours.fill_from_stations(series(s, d), neighbours.distances_within(stations(s, d), 0.12), 0.12, "idw").drop("source"), "value"),
        "co4_cell_centres": lambda s, d: cells(s, d).select("tile", "row", "col", *[F.round(c, 6).alias(n) for c, n in zip(scalars.cell_centre(F.col("row"), F.col("col"), (0.5, 0, 10.0, 0, -0.5, 45.0)), "xy")], scalars.flat_index(F.col("row"), F.col("col"), 50).alias("idx_1d")),
        "co2_utm_codes": lambda s, d: _points(s, d).select("id", scalars.utm_epsg(F.col("x") * 800, F.col("y") * 300 - 20).alias("epsg")),
        "co9_mask": lambda s, d: rounded(grid.mask(cells(s, d), _burns(s, d)), "z"),
        "ra1_gradients": lambda s, d: rounded(grid.gradients(cells(s, d)).select("tile", "row", "col", "gx", "gy"), "gx", "gy"),
        "ra2_slope_aspect": lambda s, d: rounded(grid.slope_aspect(cells(s, d)).select("tile", "row", "col", "slope", "aspect"), "slope", "aspect"),
        "ra3_curvatures": lambda s, d: rounded(grid.curvatures(cells(s, d)).select("tile", "row", "col", "profile", "planform", "twisting"), "profile", "planform", "twisting", digits=5),
        "ra6_d8_slopes": lambda s, d: rounded(grid.d8_neighbours(cells(s, d)), "dz", "length", "slope"),
        "ra7_point_gradients": lambda s, d: rounded(grid.point_gradients(cells(s, d)).select("tile", "row", "col", "gx", "gy"), "gx", "gy"),
        "ra8_resample": lambda s, d: rounded(grid.resample(cells(s, d), 4), "z"),
        "ra10_paint": lambda s, d: grid.paint(cells(s, d).select("tile", "row", "col"), _burns(s, d), -9.0),
        "jn4_cells_in_polygons": lambda s, d: grid.cells_in_polygons(_centred(s, d), _edges(s)),
        "mo1_slip_model": slip_model,
        "it1_flow_paths": flow_paths,
        "it5_top_paths": lambda s, d: paths.top_paths(read(s, d, "orders").select(F.col("o_custkey").alias("start"), F.col("o_orderkey").alias("path_id"), F.col("o_totalprice").alias("score")), 3),
    }


def oracle_sql() -> dict[str, str]:
    def nearest_fill(pick: str, extra: str) -> str:
        return f"""WITH {FULL}, {STATIONS}, sq AS (SELECT *, CAST(floor(x / 0.12) AS INT) AS bx, CAST(floor(y / 0.12) AS INT) AS by_ FROM stations), near_sq AS (SELECT station, x, y, bx + i AS bx, by_ + j AS by_ FROM sq, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
dist AS MATERIALIZED (SELECT a.station AS a, b.station AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM sq a JOIN near_sq b USING (bx, by_) WHERE a.station <> b.station AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.12),
met AS (SELECT dist.a AS station, o.ts, b, d, o.value AS v FROM obs o JOIN dist ON o.station = b),
got AS ({pick})
SELECT series.station, series.ts, round(coalesce(value, filled), 6) + 0.0 AS value{extra} FROM series LEFT JOIN got ON got.station = series.station AND got.ts = series.ts"""

    out = {
        "mo4_threshold_events": f"""WITH {FULLZ}, sm AS (SELECT station, ts, round(avg(value) OVER ({FRAME} 5 PRECEDING AND CURRENT ROW), 6) AS value FROM zs),
q AS (SELECT station, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM sm GROUP BY station),
th AS (SELECT station, round(quantile_cont(value, 0.98), 5) AS threshold FROM sm JOIN q USING (station) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY station),
al AS (SELECT station, ts, value FROM sm JOIN th USING (station) WHERE value >= threshold),
gp AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY station ORDER BY ts)) > 172800 THEN 1 ELSE 0 END AS w FROM al),
ev AS (SELECT *, CAST(1 + sum(w) OVER ({FRAME} UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event FROM gp)
SELECT station, event, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, max(value) AS peak FROM ev GROUP BY station, event""",
        "pf1_range_mask": "SELECT o_orderkey, coalesce(o_totalprice BETWEEN 1000 AND 200000, false) AS inside, round(CASE WHEN o_totalprice > 50000 THEN o_totalprice ELSE -1.0 END, 4) AS kept FROM orders",
        "pf3_no_data": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity NOT IN (1.0, 50.0) THEN l_quantity END AS quantity FROM lineitem",
        "pf13_clean_names": r"""SELECT s_suppkey, lower(trim(regexp_replace(regexp_replace(' ''A:/' || s_name || '?*_ ', '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g'), ''' _')) AS name FROM supplier""",
        "pf16_replace_values": "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 4 ELSE p_size END AS size FROM part",
        "wn13_round_minute": "SELECT event_id, to_timestamp(CAST(60 * round_even(epoch_us(ts) / 60e6, 0) AS BIGINT))::TIMESTAMP AS ts FROM events",
        "sc_delta_strings": "SELECT o_orderkey, printf('%dd-%dh-%dm-%ds', (o_orderkey * 977) // 86400, (o_orderkey * 977) % 86400 // 3600, (o_orderkey * 977) % 3600 // 60, (o_orderkey * 977) % 60) AS delta FROM orders",
        "ag1_statistics": f"WITH {FULLZ}, k AS (SELECT station, value, count(*) AS c FROM zs WHERE value > 0 GROUP BY ALL), md AS (SELECT station, min(value) AS mode FROM k WHERE (station, c) IN (SELECT (station, max(c)) FROM k GROUP BY station) GROUP BY station) SELECT station, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median, round(any_value(mode), 6) AS mode, round(quantile_cont(value, 0.8), 6) AS q1, round(quantile_cont(value, 0.9), 6) AS q2 FROM zs JOIN md USING (station) WHERE value > 0 GROUP BY station",
        "ag2_noise": f"WITH {FULLZ}, q AS (SELECT station, quantile_cont(value, 0.8) AS q FROM zs WHERE value > 0 GROUP BY station) SELECT station, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM zs JOIN q USING (station) WHERE value > 0 AND value < q GROUP BY station",
        "ag3_resample": f"WITH {FULL}, b AS (SELECT *, (row_number() OVER (PARTITION BY station ORDER BY ts DESC) - 1) // 7 AS g FROM series) SELECT station, min(ts) AS start_ts, max(ts) AS end_ts, round(coalesce(sum(value), 0.0), 6) AS value FROM b GROUP BY station, g",
        "ag7_default_threshold": f"WITH {OBS}, q AS (SELECT station, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM obs GROUP BY station) SELECT station, round(quantile_cont(value, 0.98), 6) AS threshold FROM obs JOIN q USING (station) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY station",
        "ag8_mean_step": f"WITH {OBS}, s AS (SELECT station, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY station ORDER BY ts)) AS s FROM obs) SELECT station, round(avg(s), 6) AS mean_step, min(s) = max(s) AS uniform FROM s GROUP BY station",
        "wn_moving_averages": f"WITH {FULL}, x AS (SELECT station, ts, CASE WHEN value > 0 AND value < 400 THEN value END AS x FROM series) SELECT station, ts, CASE WHEN row_number() OVER (PARTITION BY station ORDER BY ts) >= 24 THEN count(x) OVER f END AS valid, round(avg(x) OVER f, 6) AS simple, round(avg(x) OVER ({FRAME} UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative, round(avg(x) OVER f, 6) AS weighted FROM x WINDOW f AS ({FRAME} 23 PRECEDING AND CURRENT ROW)",
        "wn6_hull": f"""WITH {FULL}, l AS (SELECT station, ts, list_filter(list(value) OVER ({FRAME} 8 PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL) AS a, list_filter(list(value) OVER ({FRAME} 3 PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL) AS b FROM series),
h AS (SELECT station, ts, 2 * CASE WHEN len(b) > 0 THEN list_sum(list_transform(b, lambda v, i: v * i)) / (len(b) * (len(b) + 1) / 2) END - CASE WHEN len(a) > 0 THEN list_sum(list_transform(a, lambda v, i: v * i)) / (len(a) * (len(a) + 1) / 2) END AS h FROM l)
SELECT station, ts, round(avg(h) OVER ({FRAME} 2 PRECEDING AND CURRENT ROW), 6) + 0.0 AS hull FROM h""",
        "wn9_fill_zero": _gap_sql("coalesce(value, 0)"),
        "wn9_fill_previous": _gap_sql("coalesce(value, p)"),
        "wn9_fill_next": _gap_sql("coalesce(value, nx)"),
        "wn9_fill_mean": _gap_sql("coalesce(value, CASE WHEN p IS NULL THEN nx ELSE (p + nx) / 2 END)"),
        "wn9_fill_linear": _gap_sql("coalesce(value, CASE WHEN ni > pi THEN p + (nx - p) * (i - pi) / (ni - pi) END, p)"),
        "wn9_fill_nearest": _gap_sql("coalesce(value, CASE WHEN p IS NOT NULL AND nx IS NOT NULL THEN CASE WHEN i - pi <= ni - i THEN p ELSE nx END END)"),
        "wn9_fill_quadratic": _spline_sql("quadratic"),
        "wn9_fill_cubic": _spline_sql("cubic"),
        "wn14_fill_times": "WITH e AS (SELECT user_id AS station, event_id, CASE WHEN event_id % 4 <> 1 THEN epoch_us(ts) END AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT *, last_value(m IGNORE NULLS) OVER b AS pm, last_value(CASE WHEN m IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(m IGNORE NULLS) OVER a AS nm, first_value(CASE WHEN m IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM e WINDOW b AS (PARTITION BY station ORDER BY event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY station ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT station, event_id, CAST(floor(coalesce(m, CASE WHEN nm IS NULL THEN pm WHEN pm IS NOT NULL THEN pm + floor((nm - pm) * ((i - pi) / (ni - pi)) + 0.5) END) / 1000) AS BIGINT) AS millis FROM f",
        "wn3_wn7_recurrences": f"""WITH RECURSIVE {FULL}, r0 AS (SELECT *, row_number() OVER w - 1 AS t, avg(value) OVER f AS simple, abs(value - lag(value) OVER w) AS step, abs(value - lag(value, 24) OVER w) AS moved FROM series WINDOW w AS (PARTITION BY station ORDER BY ts), f AS ({FRAME} 23 PRECEDING AND CURRENT ROW)),
r1 AS (SELECT *, CASE WHEN count(step) OVER f = 24 THEN sum(step) OVER f END AS steps FROM r0 WINDOW f AS ({FRAME} 23 PRECEDING AND CURRENT ROW)),
r AS MATERIALIZED (SELECT *, (CASE WHEN steps <> 0 THEN moved / steps ELSE 0 END * (2.0 / 3 - 2.0 / 31) + 2.0 / 31) ** 2 AS s FROM r1),
w AS (SELECT station, ts, t, value AS ema, CAST(1 AS DOUBLE) AS weight, simple AS ada FROM r WHERE t = 0
  UNION ALL SELECT r.station, r.ts, r.t, CASE WHEN w.ema IS NULL THEN r.value WHEN r.value IS NULL THEN w.ema ELSE (w.weight * 0.92 * w.ema + 0.08 * r.value) / (w.weight * 0.92 + 0.08) END,
  CASE WHEN w.ema IS NULL OR r.value IS NOT NULL THEN 1 ELSE w.weight * 0.92 END, CASE WHEN r.t >= 24 THEN coalesce(w.ada + r.s * (r.value - w.ada), r.simple) ELSE r.simple END
  FROM w JOIN r ON r.station = w.station AND r.t = w.t + 1)
SELECT station, ts, round(ema, 6) + 0.0 AS exponential, round(ada, 6) + 0.0 AS adaptive FROM w""",
        "wn10_sessions": f"WITH {OBS}, a AS (SELECT station, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY station ORDER BY ts)) > 21600 THEN 1 ELSE 0 END AS w FROM obs WHERE value > 250) SELECT station, ts, CAST(1 + sum(w) OVER ({FRAME} UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event FROM a",
        "jn1_nearest_station": f"WITH {STATIONS}, p AS (SELECT c_custkey AS id, (c_custkey % 37) * 0.006 AS px, (c_custkey % 29) * 0.005 AS py FROM customer), m AS (SELECT id, min((sqrt((px - x) ** 2 + (py - y) ** 2), station)) AS m FROM p CROSS JOIN stations GROUP BY id) SELECT id, m[2] AS ref, round(m[1], 6) AS distance FROM m",
        "jn5_distances": f"WITH {STATIONS} SELECT a.station AS a, b.station AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM stations a CROSS JOIN stations b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 0.3",
        "ts3_fill_nearest": nearest_fill("SELECT station, ts, m[3] AS filled, 'nearest_[' || CAST(m[2] AS BIGINT) || ']' AS origin FROM (SELECT station, ts, min((d, b, v)) AS m FROM met GROUP BY station, ts)", ", CASE WHEN value IS NOT NULL THEN 'current_station' ELSE coalesce(origin, 'no_data') END AS source"),
        "in5_fill_idw": nearest_fill("SELECT station, ts, sum(v / (d * d)) / sum(1 / (d * d)) AS filled FROM met GROUP BY station, ts", ""),
        "co4_cell_centres": f"WITH {CELLS} SELECT tile, row, col, round(10.0 + (col + 0.5) * 0.5, 6) AS x, round(45.0 - (row + 0.5) * 0.5, 6) AS y, CAST(row * 50 + col AS BIGINT) AS idx_1d FROM cells",
        "co2_utm_codes": "WITH p AS (SELECT c_custkey AS id, (c_custkey % 37) * 0.006 * 800 AS lon, (c_custkey % 29) * 0.005 * 300 - 20 AS lat FROM customer) SELECT id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, floor((lon + 180) / 6) + 1) AS INT) AS epsg FROM p",
        "co9_mask": f"WITH {BURNS} SELECT tile, row, col, round(CASE WHEN (tile, row, col) IN (SELECT (tile, row, col) FROM burns) THEN z ELSE 0.0 END, 6) AS z FROM cells",
        "ra1_gradients": f"WITH {SLOPES} SELECT tile, row, col, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM g",
        "ra2_slope_aspect": f"WITH {SLOPES} SELECT tile, row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0.0 AS slope, round((degrees(atan2(-gy, gx)) + 360) % 360, 6) + 0.0 AS aspect FROM g",
        "ra3_curvatures": f"WITH {CURVES} SELECT tile, row, col, round((r * gx * gx + 2 * s * gx * gy + t * gy * gy) / (gx * gx + gy * gy + 1e-10), 5) + 0.0 AS profile, round((r * gy * gy - 2 * s * gx * gy + t * gx * gx) / (gx * gx + gy * gy + 1e-10), 5) + 0.0 AS planform, round((r * gx * gy + s * (gx * gx - gy * gy) - t * gx * gy) / (gx * gx + gy * gy + 1e-10), 5) + 0.0 AS twisting FROM k",
        "ra6_d8_slopes": f"WITH {NEIGHBOURS} SELECT tile, row, col, dir, n_row, n_col, round(dz, 6) + 0.0 AS dz, round(length, 6) AS length, round(slope, 6) + 0.0 AS slope FROM nb",
        "ra7_point_gradients": f"WITH {CELLS}, s AS (SELECT tile, max(row) AS mr, max(col) AS mc FROM cells GROUP BY tile) SELECT tile, row, col, round(CASE WHEN row > 1 AND row + 1 < mr AND col > 1 AND col + 1 < mc THEN (lead(z) OVER c - lag(z) OVER c) / 2 END, 6) + 0.0 AS gx, round(CASE WHEN row > 1 AND row + 1 < mr AND col > 1 AND col + 1 < mc THEN (lead(z) OVER r - lag(z) OVER r) / 2 END, 6) + 0.0 AS gy FROM cells JOIN s USING (tile) WINDOW c AS (PARTITION BY tile, row ORDER BY col), r AS (PARTITION BY tile, col ORDER BY row)",
        "ra8_resample": f"WITH {CELLS} SELECT tile, CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(z), 6) AS z FROM cells GROUP BY tile, row // 4, col // 4",
        "ra10_paint": f"WITH {BURNS} SELECT c.tile, c.row, c.col, coalesce(min(k) * 1.5, -9.0)::DOUBLE AS value FROM cells c LEFT JOIN burns b ON b.tile = c.tile AND b.row = c.row AND b.col = c.col GROUP BY c.tile, c.row, c.col",
        "jn4_cells_in_polygons": f"WITH {CELLS}, {EDGES}, p AS (SELECT tile, row, col, col + 0.25 AS x, row + 0.25 AS y FROM cells) SELECT tile, row, col, CAST(poly_id AS INT) AS poly_id FROM p CROSS JOIN edges GROUP BY tile, row, col, x, y, poly_id HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1",
        "mo1_slip_model": """WITH r AS (SELECT user_id AS station, date_trunc('day', ts) AS a, date_trunc('day', ts) + INTERVAL 1 DAY AS b, sum(value) / 1000 AS rain FROM events GROUP BY ALL),
w AS (SELECT x.station, x.b, CASE WHEN bool_or(abs(epoch(y.a) - (epoch(x.b) - 432000)) <= 1) THEN sum(y.rain / 1000 * exp(-0.01 * (epoch(x.b) - epoch(y.b)) / 3600)) END AS residual FROM r x JOIN r y ON y.station = x.station AND y.b <= x.b AND epoch(y.a) >= epoch(x.b) - 432000 - 1 GROUP BY x.station, x.b),
m AS (SELECT *, CASE WHEN residual IS NOT NULL THEN least(residual / (0.3 * 1.2 * (1 - 0.8)), 1.0) END AS m, radians(30.0) AS be FROM w),
f AS (SELECT *, 5.0 + 80.0 * 0.8 * (1 - 0.8) ** 0.4 * (1 - m) ** 3.4 AS c, cos(be) * 12 * (m * (0.3 - 1) + 2.7 * 0.7 + 0.8 * 0.3 * (1 - m)) AS wb, cos(be) * 12 * (m * 0.3 + 2.7 * 0.7 + 0.8 * 0.3 * (1 - m)) AS w FROM m)
SELECT station, b AS end_ts, round(residual, 9) AS residual, round((wb * cos(be) * tan(radians(20.0)) + c) / (w * sin(be)), 9) AS fs FROM f""",
        "it1_flow_paths": f"""WITH RECURSIVE {NEIGHBOURS}, best AS (SELECT tile, row, col, min((slope, dir, n_row, n_col)) AS m FROM nb GROUP BY tile, row, col HAVING count(*) = 8),
nx AS (SELECT tile, row, col, m[1] AS slope, m[3] AS nr, m[4] AS nc, degrees(atan(m[1])) AS deg FROM best),
walk AS (SELECT tile * 100000 + row * 1000 + col AS path_id, tile, row, col, 0 AS steps, [row || ':' || col] AS path, 0 AS flat, CAST(NULL AS VARCHAR) AS stop FROM cells
  UNION ALL
  SELECT path_id, tile, CASE WHEN st IS NULL THEN nr ELSE row END, CASE WHEN st IS NULL THEN nc ELSE col END, CASE WHEN st IS NULL THEN steps + 1 ELSE steps END, CASE WHEN st IS NULL THEN list_append(path, nr || ':' || nc) ELSE path END, fl, st
  FROM (SELECT *, CASE WHEN slope IS NULL THEN 'edge_reached' WHEN abs(deg) >= 7 AND deg > 0 THEN 'greater_than_tolerance_opposite_flow' WHEN list_contains(path, nr || ':' || nc) THEN 'loop_detected' WHEN fl > 1 THEN 'invalid_steps_tolerance_reached' WHEN false THEN '' END AS st
    FROM (SELECT w.*, nr, nc, slope, deg, CASE WHEN abs(deg) < 7 THEN flat + 1 ELSE 0 END AS fl FROM walk w LEFT JOIN nx ON nx.tile = w.tile AND nx.row = w.row AND nx.col = w.col WHERE w.stop IS NULL AND w.steps < 50)))
SELECT path_id, steps, coalesce(stop, 'max_runout') AS stop_reason, array_to_string(path, ',') AS cells FROM walk WHERE stop IS NOT NULL OR steps = 50""",
        "it5_top_paths": "SELECT start, path_id, score FROM (SELECT o_custkey AS start, o_orderkey AS path_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    }
    from scarpline.plans import areas, merges, rasters, records, shapes

    return {name: sql.replace("round(", f"round({NUDGE} + ") for name, sql in (out | areas.oracle_sql() | records.oracle_sql() | shapes.oracle_sql() | rasters.oracle_sql() | merges.oracle_sql()).items()}
