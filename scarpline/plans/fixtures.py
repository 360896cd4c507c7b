"""Stations, series and grids derived from the star-schema tables, and the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_COLS = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums by station, which each user is: (station, ts, value); hours without an event are missing."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("station"), F.date_trunc("hour", "ts").alias("ts"), "value")
    return e.groupBy("station", "ts").agg(F.sum("value").alias("value"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as stations on a lattice of 0.05 with 40 columns."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("station"), (F.pmod(k, F.lit(40)) * 0.05).alias("x"), (F.floor(k / 40) * 0.05).alias("y"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of a grid of 50 columns in tiles of 20 rows."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    line = F.floor(k / GRID_COLS)
    return p.select(F.floor(line / 20).cast("int").alias("tile"), F.pmod(line, F.lit(20)).cast("int").alias("row"), F.pmod(k, F.lit(GRID_COLS)).cast("int").alias("col"), (F.col("p_retailprice") + 3 * F.col("p_size")).alias("z"))


OBS = "obs AS (SELECT user_id AS station, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY ALL)"
FULL = OBS + ", axis AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM obs), series AS (SELECT s.station, a.ts, o.value FROM (SELECT DISTINCT station FROM obs) s CROSS JOIN axis a LEFT JOIN obs o ON o.station = s.station AND o.ts = a.ts)"
STATIONS = "stations AS (SELECT s_suppkey AS station, (s_suppkey % 40) * CAST(0.05 AS DOUBLE) AS x, (s_suppkey // 40) * CAST(0.05 AS DOUBLE) AS y FROM supplier)"
CELLS = f"cells AS (SELECT CAST((p_partkey // {GRID_COLS}) // 20 AS INT) AS tile, CAST((p_partkey // {GRID_COLS}) % 20 AS INT) AS row, CAST(p_partkey % {GRID_COLS} AS INT) AS col, p_retailprice + 3 * p_size AS z FROM part)"
