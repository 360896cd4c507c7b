"""TS-1, TS-2: station series on regular steps and on one axis; what doesn't fit comes as rows, not as an error on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("station",)


def _seconds(column):
    return F.unix_micros(column.cast("timestamp")) / 1e6


def uneven_rows(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """TS-1: rows (keys, ts, seconds) whose step from the row before is not the first step of their series."""
    order = Window.partitionBy(*keys).orderBy("ts")
    step = series.select(*keys, "ts", (_seconds(F.col("ts")) - _seconds(F.lag("ts").over(order))).alias("seconds"), F.row_number().over(order).alias("_r"))
    first = F.max(F.when(F.col("_r") == 2, F.col("seconds"))).over(Window.partitionBy(*keys))
    return step.withColumn("_f", first).filter("seconds IS NOT NULL AND seconds <> _f").select(*keys, "ts", "seconds")


def regrid(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """TS-1: each series (keys, ts, value) at its smallest step from its first time on.

    A slot has the value of the row that lies within half a step of it, if there is one such row alone; else null. Series of one time
    stay as they are, rows without a time go, rows of equal time count as one step of zero, which is not a step.
    """
    own = series.filter("ts IS NOT NULL").select(*keys, "ts", "value", _seconds(F.col("ts")).alias("_s"))
    order = Window.partitionBy(*keys).orderBy("_s")
    gap = F.col("_s") - F.lag("_s").over(order)
    steps = own.withColumn("_g", gap).groupBy(*keys).agg(F.min(F.when(F.col("_g") > 0, F.col("_g"))).alias("_step"), F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    steps = steps.withColumn("_step", F.coalesce("_step", F.lit(1.0)))
    axis = steps.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a")) / F.col("_step") + 1e-9)))).select(*keys, "_k", (F.col("_a") + F.col("_k") * F.col("_step")).alias("_t"))
    at = (F.col("_s") - F.col("_a")) / F.col("_step")
    # a row within half a step of a slot is nearest to it; one midway between two is near to neither
    met = own.join(steps, list(keys)).withColumn("_k", F.floor(at + 0.5).cast("long")).filter(F.abs(at - F.col("_k")) < 0.5 - 1e-9)
    one = met.groupBy(*keys, "_k").agg(F.count("*").alias("_n"), F.first("value").alias("value")).filter("_n = 1")
    return axis.join(one, [*keys, "_k"], "left").select(*keys, F.timestamp_micros(F.round(F.col("_t") * 1e6).cast("long")).alias("ts"), "value")


def spans(series: DataFrame) -> DataFrame:
    """Per station (station, first_start, last_end, shortest, longest) of rows (station, start_ts, end_ts): its period and the lengths of its rows in seconds."""
    length = _seconds(F.col("end_ts")) - _seconds(F.col("start_ts"))
    return series.groupBy("station").agg(F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end"), F.min(length).alias("shortest"), F.max(length).alias("longest"))


def shared_period(series: DataFrame, common: bool = True) -> DataFrame:
    """TS-2: one row (start, end, step): the period that all stations have, or with common=False the one around all of them."""
    own = spans(series)
    first, last = (F.max, F.min) if common else (F.min, F.max)
    return own.agg(first("first_start").alias("start"), last("last_end").alias("end"), F.min("shortest").alias("step"))


def merge_problems(series: DataFrame, common: bool = True, tolerance_seconds: float = 1.0) -> DataFrame:
    """TS-2: (station, problem, at): stations whose rows differ in length, have none in the shared period, or don't begin and end when those of the first station do.

    The last is judged row by row in the shared period, against the least station name; `at` is the first such start.
    """
    own = spans(series)
    period = shared_period(series, common)
    step = own.join(F.broadcast(period.select("step"))).filter((F.col("longest") - F.col("shortest") > 1e-6) | (F.abs(F.col("shortest") - F.col("step")) > 1e-6)).select("station", F.lit("step").alias("problem"), F.lit(None).cast("timestamp").alias("at"))
    inside = series.join(F.broadcast(period)).filter("start_ts >= start AND end_ts <= end")
    out = own.join(inside.select("station").distinct(), "station", "left_anti").select("station", F.lit("outside").alias("problem"), F.lit(None).cast("timestamp").alias("at"))
    if not common:  # every station is put on the axis itself
        return step.union(out)
    order = Window.partitionBy("station").orderBy("start_ts")
    rows = inside.select("station", "start_ts", "end_ts", F.row_number().over(order).alias("i"))
    first = rows.join(F.broadcast(rows.agg(F.min("station").alias("station"))), "station").select("i", F.col("start_ts").alias("s0"), F.col("end_ts").alias("e0"))
    off = lambda a, b: F.abs(_seconds(F.col(a)) - _seconds(F.col(b))) > tolerance_seconds
    met = rows.join(first, "i", "left").filter(F.col("s0").isNull() | off("start_ts", "s0") | off("end_ts", "e0"))
    return step.union(out).union(met.groupBy("station").agg(F.lit("times").alias("problem"), F.min("start_ts").cast("timestamp").alias("at")))


def merge_series(series: DataFrame, common: bool = True, no_data: Sequence[float] = ()) -> DataFrame:
    """TS-2: rows (station, start_ts, end_ts, value) of all stations in the period they share, or on one axis around all of them.

    With common=False the axis goes from the first start to the last end at the common step, and a station has null where it has no row of
    the same start. no_data values become null.
    """
    value = F.when(~F.coalesce(F.col("value").isin(*map(float, no_data)), F.lit(False)), F.col("value")) if no_data else F.col("value")
    period = shared_period(series, common)
    if common:
        return series.join(F.broadcast(period)).filter("start_ts >= start AND end_ts <= end").select("station", "start_ts", "end_ts", value.alias("value"))
    kind = dict(series.dtypes)["start_ts"]
    axis = period.filter("start IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((_seconds(F.col("end")) - _seconds(F.col("start"))) / F.col("step") - 1e-9) - 1)))
    micros = lambda k: F.timestamp_micros((F.unix_micros(F.col("start").cast("timestamp")) + k * F.col("step") * 1_000_000).cast("long")).cast(kind)
    axis = axis.select(micros(F.col("k")).alias("start_ts"), micros(F.col("k") + 1).alias("end_ts"))
    # every station on every time of the axis is what the result holds
    full = series.select("station").distinct().join(axis)
    return full.join(series.select("station", "start_ts", value.alias("value")), ["station", "start_ts"], "left").select("station", "start_ts", "end_ts", "value")


def wide(merged: DataFrame, stations: Sequence) -> DataFrame:
    """TS-2: one row a time, one column for each of the named stations."""
    return merged.groupBy("start_ts", "end_ts").pivot("station", list(stations)).agg(F.first("value"))
