"""The same analyses over streams: windowed sums, thresholds and events of station records that arrive late or twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(stream: DataFrame, late: str = "1 hour", keys=("station", "ts")) -> DataFrame:
    """Records (station, ts, value) up to `late` behind the newest; a record that arrives again goes. State ends with the watermark."""
    return stream.filter("ts IS NOT NULL AND station IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def window_sums(stream: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """AG-3 over a stream that has a watermark: count, sum, mean, min and max by station and window."""
    own = stream.groupBy(F.window("ts", size, slide or size).alias("w"), "station").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return own.select("station", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "total", "mean", "low", "high")


def exceedances(stream: DataFrame, limits: DataFrame, below: bool = False) -> DataFrame:
    """MO-3: the records at or beyond their station's threshold; limits (station, threshold) is a static table."""
    hit = F.col("value") <= F.col("threshold") if below else F.col("value") >= F.col("threshold")
    return stream.join(limits, "station").filter(hit)


def events(alerts: DataFrame, tolerance: str = "5 days") -> DataFrame:
    """WN-10, MO-4: runs of alerts of a station with gaps of at most the tolerance: start_ts, end_ts, n, peak.

    A session window keeps its last record's time as an aggregate, as its own end lies one tolerance later. In append
    mode an event is given once the watermark has passed it by the tolerance.
    """
    own = alerts.groupBy(F.session_window("ts", tolerance).alias("w"), "station").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"), F.max("value").alias("peak"))
    return own.select("station", "start_ts", "end_ts", "n", "peak")
