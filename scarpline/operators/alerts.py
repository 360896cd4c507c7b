"""Alerts of attention areas: areas from paths, pixel series, thresholds, activated pixels and the paths that they threaten.

An area is known by its starting point. Pixels are rows (area, tile, row, col); nothing is gathered into one row but the
cells and paths of one alert, which the area bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarpline.operators import timeseries

CELL = ("tile", "row", "col")
#: Parameters of a pixel that no class gives.
DEFAULTS = {"GS": 2.7, "c": 5.0, "cr": 0.0, "phi": 20.0, "kt": 0.001, "beta": 1.0, "A": 80.0, "n": 0.3}


def attention_areas(paths: DataFrame) -> DataFrame:
    """AG-5: the distinct cells (area, tile, row, col) of all paths (start, tile, cells) of each starting point."""
    return paths.select(F.col("start").alias("area"), "tile", F.explode("cells").alias("c")).select("area", "tile", "c.row", "c.col").distinct()


def station_pixels(pixels: DataFrame) -> DataFrame:
    """JN-15: per station its pixels (tile, row, col, area) as one sorted list."""
    return pixels.groupBy("station").agg(F.sort_array(F.collect_set(F.struct(*CELL, "area"))).alias("pixels"))


def pixel_series(pixels: DataFrame, series: DataFrame) -> DataFrame:
    """MO-3, JN-11: the values (station, ts, value) of each pixel's station, once for every area and station.

    Pixels of one area and station share their series, so the join is made on these pairs and not on the pixels.
    """
    pairs = pixels.groupBy("area", "station").agg(F.count("*").alias("pixels"))
    return series.join(pairs, "station").select("area", "station", "pixels", "ts", "value")


def metric_statistics(rows: DataFrame) -> DataFrame:
    """AG-6: over all pixels and times of an area mean, deviation (divided by n), maximum and minimum, nulls left out.

    rows: area, pixels, value; each value counts once for every pixel that shares it. The deviation is taken from the mean itself, in a
    second pass, so that it is right for large values that differ little.
    """
    own = rows.filter("value IS NOT NULL")
    first = own.groupBy("area").agg((F.sum(F.col("pixels") * F.col("value")) / F.sum("pixels")).alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))
    apart = own.join(first.select("area", "mean"), "area").groupBy("area").agg(F.sqrt(F.sum(F.col("pixels") * (F.col("value") - F.col("mean")) ** 2) / F.sum("pixels")).alias("std"))
    return first.join(apart, "area").select("area", "mean", "std", "max", "min")


def thresholds(statistics: DataFrame, quantiles: DataFrame | None = None, mode: str = "quantile", value: float | None = None) -> DataFrame:
    """AG-7, MO-6: (area, threshold): a given number, a quantile by area, three quarters of the maximum or 1.05 times the minimum."""
    if value is not None:
        return statistics.select("area", F.lit(float(value)).alias("threshold"))
    if mode == "quantile":
        return statistics.select("area").join(quantiles, "area")
    return statistics.select("area", {"max": 0.75 * F.col("max"), "min": 1.05 * F.col("min")}[mode].alias("threshold"))


def alert_times(rows: DataFrame, limits: DataFrame, below: bool = False, tolerance_seconds: int = 5 * 86400) -> DataFrame:
    """MO-4: (area, ts, event, stations, pixels): the times at which any pixel of an area reaches its threshold, by event."""
    hit = F.col("value") <= F.col("threshold") if below else F.col("value") >= F.col("threshold")
    hits = rows.join(limits, "area").filter(hit).groupBy("area", "ts").agg(F.sort_array(F.collect_set("station")).alias("stations"), F.sum("pixels").alias("pixels"))
    named = timeseries.sessions(hits, tolerance_seconds, ("area",))
    return named.withColumn("event", F.concat(F.lit("rt"), F.col("event").cast("string")))


def activated_pixels(alerts: DataFrame, pixels: DataFrame) -> DataFrame:
    """MO-4: the pixels (area, ts, event, tile, row, col) that each alert activates, by its stations."""
    each = alerts.select("area", "ts", "event", F.explode("stations").alias("station"))
    return each.join(pixels, ["area", "station"]).select("area", "ts", "event", *CELL)


def critical_paths(activated: DataFrame, paths: DataFrame, n: int = 5) -> DataFrame:
    """JN-10, JN-13: per area and event the n paths of best score that share a cell with its activated pixels."""
    cells = paths.select("path_id", "score", F.col("start").alias("area"), "tile", F.explode("cells").alias("c")).select("path_id", "score", "area", "tile", "c.row", "c.col")
    return critical_cells(activated, cells, n)


def critical_cells(activated: DataFrame, cells: DataFrame, n: int = 5) -> DataFrame:
    """JN-10: critical_paths() of paths given as rows (path_id, score, area, tile, row, col), a cell as often as one likes.

    Both sides are dealt by area and cell once, over spark.sql.shuffle.partitions tasks, made distinct there and joined as they lie, so few large tasks
    are not made of them.
    """
    key = ["area", *CELL]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *more: df.select(*key, *more).repartition(tasks, *key).distinct()
    met = dealt(activated, "event").join(dealt(cells, "path_id", "score"), key).groupBy("area", "event", "path_id").agg(F.max("score").alias("score"), F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("area", "event").orderBy(F.desc("score"), "path_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= n)


def with_defaults(pixels: DataFrame) -> DataFrame:
    """MO-2: missing slopes and those below zero are flat, missing parameters take their defaults, beta is scaled by the slope's cosine."""
    slope = F.when(F.col("slope") > 0, F.col("slope")).otherwise(0.0)
    filled = {k: F.coalesce(F.col(k), F.lit(v)) if k in pixels.columns else F.lit(v) for k, v in DEFAULTS.items()}
    out = pixels.withColumns({**filled, "slope": slope})
    return out.withColumn("beta", F.col("beta") * F.cos(F.radians("slope")))


def safety_factors(pixels: DataFrame, rain: DataFrame, window_days: float = 30) -> DataFrame:
    """MO-2: the factor of safety (area, tile, row, col, station, end_ts, fs) of every pixel at every time.

    pixels: area, station, cell, slope and parameters; rain: station, start_ts, end_ts, rain (mm), a missing value being
    none. The decayed rain depends on the station and kt alone: it is summed once for each such pair and joined on.
    """
    from scarpline.operators import model

    own = with_defaults(pixels)
    pairs = own.select("station", "kt").distinct()
    wet = rain.withColumn("rain", F.coalesce("rain", F.lit(0.0))).join(pairs, "station")
    residual = model.residual_rain(wet, window_days).select("station", "kt", "end_ts", "residual")
    met = own.join(residual, ["station", "kt"])
    m = model.saturation_ratio(F.col("residual"), F.col("beta"), F.col("n"))
    fs = model.factor_of_safety(F.col("slope"), m, F.col("GS"), F.col("c"), F.col("cr"), F.col("phi"), F.col("A"), F.col("n"))
    return met.select("area", *CELL, "station", "end_ts", fs.alias("fs"))


def reference_points(points: DataFrame, morphology: DataFrame, parameters: DataFrame, stations: DataFrame, cell: float) -> DataFrame:
    """MO-7: points (id, x, y, tile, row, col) with the morphology and parameters of their cell, and their nearest station.

    Points without a cell keep nulls.
    """
    from scarpline.operators.neighbours import nearest

    at = nearest(points.select("id", "x", "y"), stations.select(F.col("station").alias("ref"), F.col("x").alias("rx"), F.col("y").alias("ry")), cell)
    near = at.select("id", F.col("ref").alias("nearest_station"), F.col("distance").alias("dist_to_nearest_station"))
    return points.join(morphology, list(CELL), "left").join(parameters, list(CELL), "left").join(near, "id", "left")
