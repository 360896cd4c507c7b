"""Registered queries on merged and regridded series, scattered values on grids and grown areas, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.operators import merging, scatter
from scarpline.plans.fixtures import CELLS, OBS, STATIONS, cells, observations, stations


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly values some minutes late, by the hour."""
    minutes = F.pmod(F.hour("ts") * 7, F.lit(5))
    return observations(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + minutes.cast("long") * 60_000_000))


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station from its own first to its own last hour, without a gap."""
    obs = observations(spark, sf_dir)
    axis = obs.groupBy("station").agg(F.explode(F.sequence(F.min("ts"), F.max("ts"), F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    full = axis.join(obs, ["station", "ts"], "left")
    return full.select("station", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"), "value")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with every seventh station five seconds late and every eleventh in rows of two hours."""
    late = F.when(F.col("station") % 7 == 0, F.expr("INTERVAL 5 SECONDS")).otherwise(F.expr("INTERVAL 0 SECONDS"))
    longer = F.when(F.col("station") % 11 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 SECONDS"))
    return _periods(spark, sf_dir).withColumns({"start_ts": F.col("start_ts") + late, "end_ts": F.col("end_ts") + late + longer})


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("tile", "row", "col", (F.col("col") * 0.041 + 0.013).alias("x"), (F.col("row") * 0.011 + F.col("tile") * 0.007 + 0.003).alias("y"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations(spark, sf_dir).select(F.col("x").alias("px"), F.col("y").alias("py"), (3 * F.col("x") - 2 * F.col("y") + 1).alias("v"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scarpline.plans import queries as base

    rounded = base.rounded
    millis = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("long").alias(c)

    def grid(method, limit):
        return lambda s, d: rounded(scatter.scatter_to_grid(_targets(s, d), _values(s, d), method, 0.15, limit).select("tile", "row", "col", "value"), "value")

    return {
        "ts1_regrid": lambda s, d: rounded(merging.regrid(_shifted(s, d)).select("station", millis("ts"), "value"), "value"),
        "ts1_uneven_rows": lambda s, d: rounded(merging.uneven_rows(observations(s, d)), "seconds"),
        "ts2_merge_common": lambda s, d: rounded(merging.merge_series(_periods(s, d)), "value"),
        "ts2_merge_union": lambda s, d: rounded(merging.merge_series(_periods(s, d), common=False), "value"),
        "ts2_merge_problems": lambda s, d: merging.merge_problems(_late(s, d)).select("station", "problem"),
        "ra9_scatter_nearest": grid("nearest", 0.02),
        "ra9_scatter_linear": grid("linear", 0.03),
    }


def oracle_sql() -> dict[str, str]:
    periods = f"{OBS}, ends AS (SELECT station, min(ts) AS a, max(ts) AS b FROM obs GROUP BY station), p AS (SELECT e.station, t.ts AS start_ts, t.ts + INTERVAL 1 HOUR AS end_ts, value FROM (SELECT station, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM ends) t JOIN ends e USING (station) LEFT JOIN obs o ON o.station = t.station AND o.ts = t.ts)"
    common = "(SELECT max(a) AS s, min(b + INTERVAL 1 HOUR) AS e FROM ends)"
    targets = f"{CELLS}, {STATIONS}, t AS (SELECT tile, row, col, col * CAST(0.041 AS DOUBLE) + CAST(0.013 AS DOUBLE) AS x, row * CAST(0.011 AS DOUBLE) + tile * CAST(0.007 AS DOUBLE) + CAST(0.003 AS DOUBLE) AS y FROM cells)"
    # stations lie on a lattice, so the nearest one is found among the places around
    near = "m AS (SELECT t.tile, t.row, t.col, min((sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2), s.x, s.y)) AS m FROM t JOIN stations s ON s.x BETWEEN t.x - 0.06 AND t.x + 0.06 AND s.y BETWEEN t.y - 0.06 AND t.y + 0.06 GROUP BY ALL)"
    # the hull of the lattice: all its full rows, and the part of the last one
    lattice = "h AS (SELECT max(station) // 40 AS full_rows, max(station) % 40 AS last FROM stations)"
    return {
        "ts1_regrid": f"""WITH {OBS}, o AS (SELECT station, CAST(epoch(ts) AS BIGINT) + hour(ts) * 7 % 5 * 60 AS s, value FROM obs),
d AS (SELECT *, s - lag(s) OVER (PARTITION BY station ORDER BY s) AS g FROM o), st AS (SELECT station, coalesce(min(CASE WHEN g > 0 THEN g END), 1) AS step, min(s) AS a, max(s) AS b FROM d GROUP BY station),
ax AS (SELECT station, step, a, unnest(range((b - a) // step + 1)) AS k FROM st),
r AS (SELECT o.station, value, CAST(floor((s - a) / step + 0.5) AS BIGINT) AS k FROM o JOIN st USING (station) WHERE abs((s - a) / step - floor((s - a) / step + 0.5)) < 0.5 - 1e-9),
one AS (SELECT station, k, any_value(value) AS value FROM r GROUP BY station, k HAVING count(*) = 1)
SELECT ax.station, CAST((a + ax.k * step) * 1000 AS BIGINT) AS ts, round(value, 6) + 0.0 AS value FROM ax LEFT JOIN one ON one.station = ax.station AND one.k = ax.k""",
        "ts1_uneven_rows": f"WITH {OBS}, d AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER w) AS g, row_number() OVER w AS r FROM obs WINDOW w AS (PARTITION BY station ORDER BY ts)), f AS (SELECT station, g AS f FROM d WHERE r = 2) SELECT station, ts, round(CAST(g AS DOUBLE), 6) AS seconds FROM d JOIN f USING (station) WHERE g <> f",
        "ts2_merge_common": f"WITH {periods} SELECT station, start_ts, end_ts, round(value, 6) + 0.0 AS value FROM p, {common} c WHERE start_ts >= s AND end_ts <= e",
        "ts2_merge_union": f"WITH {periods}, ax AS (SELECT unnest(generate_series(min(a), max(b), INTERVAL 1 HOUR)) AS start_ts FROM ends) SELECT ends.station, ax.start_ts, ax.start_ts + INTERVAL 1 HOUR AS end_ts, round(value, 6) + 0.0 AS value FROM ends CROSS JOIN ax LEFT JOIN p ON p.station = ends.station AND p.start_ts = ax.start_ts",
        "ts2_merge_problems": f"""WITH {periods}, l AS (SELECT station, start_ts + CASE WHEN station % 7 = 0 THEN INTERVAL 5 SECONDS ELSE INTERVAL 0 SECONDS END AS s, end_ts + CASE WHEN station % 7 = 0 THEN INTERVAL 5 SECONDS ELSE INTERVAL 0 SECONDS END + CASE WHEN station % 11 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 SECONDS END AS e FROM p),
u AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(s) AS a, max(e) AS b FROM l GROUP BY station)), i AS (SELECT station, s, e, row_number() OVER (PARTITION BY station ORDER BY s) AS r FROM l, u WHERE s >= a AND e <= b),
f AS (SELECT * FROM i WHERE station = (SELECT min(station) FROM i)),
bad AS (SELECT DISTINCT i.station FROM i LEFT JOIN f USING (r) WHERE f.s IS NULL OR abs(epoch(i.s) - epoch(f.s)) > 1 OR abs(epoch(i.e) - epoch(f.e)) > 1)
SELECT DISTINCT station, 'step' AS problem FROM l WHERE station % 11 = 0 UNION ALL SELECT station, 'times' FROM bad UNION ALL SELECT DISTINCT station, 'outside' FROM l WHERE station NOT IN (SELECT station FROM i)""",
        "ra9_scatter_nearest": f"WITH {targets}, {near} SELECT t.tile, t.row, t.col, round(CASE WHEN m[1] <= 0.02 THEN 3 * m[2] - 2 * m[3] + 1 END, 6) + 0.0 AS value FROM t LEFT JOIN m USING (tile, row, col)",
        "ra9_scatter_linear": f"""WITH {targets}, {near}, {lattice}, c AS (SELECT t.*, m[1] AS dist, full_rows * CAST(0.05 AS DOUBLE) AS top, last * CAST(0.05 AS DOUBLE) AS lx FROM t LEFT JOIN m USING (tile, row, col), h)
SELECT tile, row, col, round(CASE WHEN dist <= 0.03 AND y >= 0 AND x <= 1.95 + 1e-9 AND x >= 0 AND y <= top + 1e-9
  AND (top - y) * (1.95 - lx) >= (x - lx) * 0.05 - 1e-9 THEN 3 * x - 2 * y + 1 END, 6) + 0.0 AS value FROM c""",
    }
