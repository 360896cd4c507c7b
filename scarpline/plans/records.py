"""Registered queries on records: kinds, differences, updates, associations, slots, blocks, parameters, areas of paths and critical paths, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scarpline.functions import scalars
from scarpline.operators import alerts, grid, timeseries
from scarpline.plans import queries as base
from scarpline.plans.fixtures import CELLS, FULL, OBS, cells, observations, read
from scarpline.sources import tables

METHODS = {"min": "min(z)", "max": "max(z)", "sum": "sum(z)", "median": "median(z)", "q1": "quantile_cont(z, 0.25)", "q3": "quantile_cont(z, 0.75)", "rms": "sqrt(avg(z * z))"}


def _castable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, numbers and days as strings, and what they can be read as."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    texts = F.explode(F.array(F.col("s_name"), F.col("s_acctbal").cast("string"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"))).alias("t")
    return s.select("s_suppkey", texts).select("s_suppkey", *[scalars.castable(F.col("t"), kind).alias(kind) for kind in ("numeric", "datetime")])


def _prices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders' prices, and later ones: the dear ones raised, the cheap ones gone."""
    a = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    raised = F.when(F.col("price") > 200000, F.col("price") + 10).otherwise(F.col("price") + 0.001)
    return a, a.filter("price > 20000").withColumn("price", raised)


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.differences(*_prices(spark, sf_dir), ["o_orderkey"], 0.01)
    return found.select("o_orderkey", F.round("a.price", 4).alias("before"), F.round("b.price", 4).alias("after"))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _prices(spark, sf_dir)
    dear = b.filter("price > 200000")
    out = tables.upsert(a, dear.union(dear.withColumn("o_orderkey", -F.col("o_orderkey"))), ["o_orderkey"])
    return base.rounded(out, "price", digits=4)


def associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("label"))
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("label"))
    return tables.associate(n, names, "key", ["label"])


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each station's values go one way in time."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy("station").orderBy("ts"))
    return observations(spark, sf_dir).withColumn("step", step).groupBy("station").agg(scalars.is_ordered(F.col("step")).alias("ordered"))


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", "value")
    return base.rounded(timeseries.snap(e, 7200), "value")


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over 12 hours in which an hour weighs one more than its number."""
    out = timeseries.moving_averages(base.series(spark, sf_dir), 12, 0.0, weights=F.hour("ts") + 1.0)
    return base.rounded(out.select("station", "ts", "weighted"), "weighted")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_id"), (F.col("n_regionkey") * 2.5).alias("c"), (20.0 + F.col("n_nationkey")).alias("phi"))


def class_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = base._burns(spark, sf_dir).withColumn("class_id", F.col("priority"))
    found = grid.class_parameters(cells(spark, sf_dir).select("tile", "row", "col"), covered, _classes(spark, sf_dir), ["c", "phi"])
    return found.select("tile", "row", "col", "class_id", "c", "phi")


def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir).select("tile", "row", "col", (F.col("z") / 30 - 40).alias("slope"), F.when(F.col("z") > 1300, F.col("z") / 100).alias("c"))
    return base.rounded(alerts.with_defaults(own).select("tile", "row", "col", "slope", "c", "phi", "beta"), "slope", "c", "beta")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paths: their customer is the start, their parts the cells, in the order of the lines."""
    k = F.col("l_partkey")
    cell = F.struct(F.floor(k / 50).cast("int").alias("row"), F.pmod(k, F.lit(50)).cast("int").alias("col"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("start"), F.col("o_totalprice").alias("score"))
    return orders.join(lines, "path_id").withColumn("tile", F.lit(0))


def critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through cells that their customers have returned, events being the states of the lines."""
    k = F.col("l_partkey")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = [F.col("o_custkey").alias("area"), F.lit(0).alias("tile"), F.floor(k / 50).cast("int").alias("row"), F.pmod(k, F.lit(50)).cast("int").alias("col")]
    activated = lines.filter("l_returnflag = 'R'").select(F.col("l_linestatus").alias("event"), *at)
    return alerts.critical_cells(activated, lines.select(F.col("o_orderkey").alias("path_id"), F.col("o_totalprice").alias("score"), *at), 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    resampled = lambda how: lambda s, d: base.rounded(grid.resample(cells(s, d), 4, how), "z")
    blocks = lambda how: lambda s, d: base.rounded(timeseries.resample(base.series(s, d), 7, how), "value")
    return {
        "pf4_castable": _castable,
        "pf6_differences": differences,
        "pf9_ordered": ordered,
        "pf15_associate": associate,
        "sk5_upsert": upsert,
        "jn6_snap": snapped,
        "wn5_weighted": weighted,
        "ra11_class_parameters": class_parameters,
        "mo2_defaults": defaults,
        "ag5_attention_areas": lambda s, d: alerts.attention_areas(_paths(s, d)),
        "jn10_critical_paths": critical,
        "co3_units": lambda s, d: base._points(s, d).select("id", scalars.unit_of_epsg(scalars.utm_epsg(F.col("x") * 800, F.col("y") * 300 - 20) + F.when(F.col("x") > 0.1, 100).otherwise(0)).alias("unit")),
        "co8_rows_and_columns": lambda s, d: read(s, d, "part").select("p_partkey", *[c.alias(n) for c, n in zip(scalars.row_col(F.col("p_partkey"), 50), ("row", "col"))]),
        **{f"ra8_resample_{how}": resampled(how) for how in METHODS},
        **{f"ag3_resample_{how}": blocks(how) for how in ("mean", "min", "max")},
    }


def oracle_sql() -> dict[str, str]:
    paths = "p AS (SELECT o_orderkey AS path_id, o_custkey AS area, o_totalprice AS score, CAST(l_partkey // 50 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
    later = "b AS (SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_totalprice > 200000 THEN 10 ELSE 0.001 END AS price FROM orders WHERE o_totalprice > 20000)"
    block = f"WITH {FULL}, b AS (SELECT *, (row_number() OVER (PARTITION BY station ORDER BY ts DESC) - 1) // 7 AS g FROM series) SELECT station, min(ts) AS start_ts, max(ts) AS end_ts, round({{how}}(value), 6) AS value FROM b GROUP BY station, g"
    return {
        "pf4_castable": "WITH t AS (SELECT s_suppkey, unnest([s_name, CAST(s_acctbal AS VARCHAR), strftime(DATE '2020-01-01' + CAST(s_suppkey % 300 AS INT), '%Y-%m-%d')]) AS t FROM supplier) SELECT s_suppkey, TRY_CAST(t AS DOUBLE) IS NOT NULL AS numeric, TRY_CAST(t AS TIMESTAMP) IS NOT NULL AS datetime FROM t",
        "pf6_differences": f"WITH {later} SELECT o_orderkey, round(o_totalprice, 4) AS before, round(price, 4) AS after FROM orders LEFT JOIN b USING (o_orderkey) WHERE price IS NULL OR abs(price - o_totalprice) > 0.01",
        "pf9_ordered": f"WITH {OBS}, s AS (SELECT station, value - lag(value) OVER (PARTITION BY station ORDER BY ts) AS step FROM obs) SELECT station, coalesce(min(step) >= 0 OR max(step) <= 0, true) AS ordered FROM s GROUP BY station",
        "pf15_associate": "SELECT c_custkey, c_nationkey AS key, CASE WHEN n_regionkey > 1 THEN n_name ELSE c_mktsegment END AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
        "sk5_upsert": f"WITH {later}, d AS (SELECT * FROM b WHERE price > 200000) SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS price FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT o_orderkey, o_orderstatus, round(price, 4) FROM d UNION ALL SELECT -o_orderkey, o_orderstatus, round(price, 4) FROM d",
        "jn6_snap": "WITH s AS (SELECT user_id AS station, epoch_us(ts) / 1e6 AS t, floor(epoch_us(ts) / 1e6 / 7200 + 0.5) AS slot, value FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY station, slot) AS n FROM s WHERE abs(t - slot * 7200) < 3600) SELECT station, to_timestamp(slot * 7200)::TIMESTAMP AS ts, round(value, 6) AS value FROM k WHERE n = 1",
        "wn5_weighted": f"WITH {FULL}, x AS (SELECT station, ts, CASE WHEN value > 0 THEN value END AS x, hour(ts) + 1 AS w FROM series) SELECT station, ts, round(sum(w * x) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f, 6) AS weighted FROM x WINDOW f AS ({base.FRAME} 11 PRECEDING AND CURRENT ROW)",
        "ra11_class_parameters": f"WITH {base.BURNS}, m AS (SELECT tile, row, col, min(k) AS class_id FROM burns GROUP BY ALL) SELECT tile, row, col, class_id, CAST(n_regionkey * 2.5 AS DOUBLE) AS c, CAST(20 + class_id AS DOUBLE) AS phi FROM (SELECT tile, row, col FROM cells) LEFT JOIN m USING (tile, row, col) LEFT JOIN nation ON n_nationkey = class_id",
        "mo2_defaults": f"WITH {CELLS}, s AS (SELECT tile, row, col, z, greatest(z / 30 - 40, 0.0) AS slope FROM cells) SELECT tile, row, col, round(slope, 6) AS slope, round(CASE WHEN z > 1300 THEN z / 100 ELSE 5.0 END, 6) AS c, CAST(20.0 AS DOUBLE) AS phi, round(cos(radians(slope)), 6) AS beta FROM s",
        "ag5_attention_areas": f"WITH {paths} SELECT DISTINCT area, 0 AS tile, row, col FROM p",
        "jn10_critical_paths": f"""WITH {paths}, a AS (SELECT DISTINCT o_custkey AS area, l_linestatus AS event, CAST(l_partkey // 50 AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
m AS (SELECT a.area, event, path_id, max(score) AS score, count(DISTINCT (a.row, a.col)) AS shared FROM a JOIN p ON p.area = a.area AND p.row = a.row AND p.col = a.col GROUP BY a.area, event, path_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY area, event ORDER BY score DESC, path_id) AS INT) AS rank FROM m) SELECT * FROM r WHERE rank <= 3""",
        "co3_units": "WITH p AS (SELECT c_custkey AS id, (c_custkey % 37) * 0.006 AS x, (c_custkey % 29) * 0.005 * 300 - 20 AS lat FROM customer) SELECT id, CASE WHEN lat < 0 AND x > 0.1 THEN 'unknown' ELSE 'meter' END AS unit FROM p",
        "co8_rows_and_columns": "SELECT p_partkey, CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col FROM part",
        **{f"ra8_resample_{how}": f"WITH {CELLS} SELECT tile, CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round({sql}, 6) AS z FROM cells GROUP BY tile, row // 4, col // 4" for how, sql in METHODS.items()},
        **{f"ag3_resample_{how}": block.format(how={"mean": "avg"}.get(how, how)) for how in ("mean", "min", "max")},
    }
