"""Slope stability under rainfall: residual water and factor of safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the model: depth (m), saturation, exponents, unit weight of water (kN/m3).
DEPTH, SATURATION, LAMBDA, ALPHA, GAMMA_W = 1.2, 0.8, 0.4, 3.4, 10.0


def residual_rain(rain: DataFrame, window_days: float = 30, tolerance_seconds: float = 1.0) -> DataFrame:
    """MO-1, its sum: for (station, kt) and each row (start_ts, end_ts, rain in mm) the metres of decayed rain of the window.

    Null until a row starts one window before the end. A range window gathers the rows of the window, whose number the
    step bounds; the series is keyed by station and kt, so that pixels of like soil share one sum.
    """
    seconds = F.unix_micros("end_ts") / 1e6
    start = F.unix_micros("start_ts") / 1e6
    frame = Window.partitionBy("station", "kt").orderBy("_t").rangeBetween(-int(window_days * 86400), 0)
    timed = rain.withColumns({"_t": seconds.cast("long"), "_s": start})
    listed = timed.withColumn("_rows", F.collect_list(F.struct("_t", "_s", "rain")).over(frame))
    since = F.col("_t") - window_days * 86400
    full = F.exists("_rows", lambda r: F.abs(r["_s"] - since) <= tolerance_seconds)
    inside = F.filter("_rows", lambda r: r["_s"] >= since - tolerance_seconds)
    total = F.aggregate(inside, F.lit(0.0), lambda acc, r: acc + r["rain"] / 1000 * F.exp(-F.col("kt") * (F.col("_t") - r["_t"]) / 3600))
    return listed.withColumn("residual", F.when(full, total)).drop("_rows", "_t", "_s")


def saturation_ratio(residual: Column, beta: Column, n: Column) -> Column:
    """MO-1: the saturated share of the depth, at most 1; null while the window is not full."""
    return F.when(residual.isNotNull(), F.least(residual * beta / (n * DEPTH * (1 - SATURATION)), F.lit(1.0)))


def factor_of_safety(slope: Column, m: Column, gs: Column, c: Column, cr: Column, phi: Column, a: Column, n: Column) -> Column:
    """MO-1: of slope and friction angles in degrees; infinite on flat ground."""
    beta = F.radians(slope)
    cohesion = c + cr + a * SATURATION * (1 - SATURATION) ** LAMBDA * F.pow(1 - m, F.lit(ALPHA))
    dry = gs * (1 - n) + SATURATION * n * (1 - m)
    buoyant = F.cos(beta) * DEPTH * GAMMA_W * (m * (n - 1) + dry)
    weight = F.cos(beta) * DEPTH * GAMMA_W * (m * n + dry)
    return F.when(F.sin(beta) == 0, F.lit(float("inf"))).otherwise((buoyant * F.cos(beta) * F.tan(F.radians(phi)) + cohesion) / F.nullif(weight * F.sin(beta), F.lit(0.0)))
