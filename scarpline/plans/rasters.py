"""Registered queries on raster files and resampling, with their SQL: the cells are written as GeoTIFF files and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarpline.operators import grid, kernels, polygons
from scarpline.plans.fixtures import CELLS, cells, read
from scarpline.sources import rasters

ROWS, COLS, STRIP, EPSG = 12, 16, 4, 32633
METHODS = ("nearest", "bilinear", "cubic", "spline", "lanczos", "average", "sum", "rms")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.write_tiles(cells(spark, sf_dir), (1.0, 100.0, -1.0, 40.0), ROWS, COLS, EPSG, strip_rows=STRIP)


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each region, in the upper and middle part of a tile."""
    k = F.col("r_regionkey")
    x, y = 101.3 + k * 4, 38.7 - k * 2
    return read(spark, sf_dir, "region").select(k.alias("poly_id"), F.lit(0).alias("part"), F.lit(False).alias("hole"), polygons.rectangle(x, x + 2.4, y - 3, y).alias("ring"))


def _named(found: DataFrame, path: str = "path") -> DataFrame:
    """The tile, and the cell's place in it, from a file's name."""
    p = F.split(F.replace(F.col(path), F.lit(".tif")), "_")
    return found.withColumns({"tile": p[0].cast("int"), "row": (F.col("row") + p[1].cast("int")).cast("int"), "col": (F.col("col") + p[2].cast("int")).cast("int")})


def _sizes(own: DataFrame) -> DataFrame:
    size = own.groupBy("tile").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    return size.withColumns({"new_rows": (F.floor(F.col("rows") * 3 / 5) + 1).cast("int"), "new_cols": F.floor(F.col("cols") * 13 / 10).cast("int")})


def _resampled(method: str):
    from scarpline.plans import queries as base

    def run(spark, sf_dir):
        own = cells(spark, sf_dir)
        return base.rounded(kernels.resample_cells(own, _sizes(own), method), "z")

    return run


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.pmod(k, F.lit(3)).cast("int").alias("tile"), F.pmod(k * 7, F.lit(1100)).cast("int").alias("idx_1d"))


def _pixel_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = grid.fake_coordinates(cells(spark, sf_dir))
    pixels = own.select((F.col("tile") * 10 + F.floor(F.col("col") / 25)).cast("int").alias("area"), "tile", "row", "col", F.pmod(F.col("row") * 50 + F.col("col"), F.lit(40)).cast("long").alias("station"))
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("station"), F.col("s_name").alias("name"))
    return grid.pixel_info(pixels, own, names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scarpline.plans import queries as base

    rounded = base.rounded
    return {
        "sc6_raster_cells": lambda s, d: rounded(_named(rasters.read_cells(_files(s, d)).filter("z IS NOT NULL")).select("tile", "row", "col", "x", "y", "z"), "x", "y", "z"),
        "sc7_raster_profiles": lambda s, d: rounded(rasters.profiles(_files(s, d)).select("path", "width", "height", "bands", "dtype", "no_data", "epsg", "x_min", "y_min", "x_max", "y_max"), "no_data", "x_min", "y_min", "x_max", "y_max"),
        "ra13_block_plan": lambda s, d: rasters.block_plan(_files(s, d), _mask(s, d)),
        "ra13_import_grid": lambda s, d: rounded(_named(rasters.import_grid(_files(s, d), _mask(s, d)).withColumnRenamed("tile", "path")).select("tile", "row", "col", "x", "y", "z", "inside"), "x", "y", "z"),
        "co10_pick_cells": lambda s, d: rounded(grid.pick_cells(cells(s, d), _picks(s, d), 50), "z"),
        "co11_fake_coordinates": lambda s, d: grid.fake_coordinates(cells(s, d)).select("tile", "row", "col", "x", "y"),
        "pf9_ordered_grids": lambda s, d: grid.grids_ordered(grid.fake_coordinates(cells(s, d)).withColumn("x", F.when(F.col("tile") % 2 == 1, F.pmod(F.col("x"), F.lit(7))).otherwise(F.col("x")))),
        "ag9_no_data": lambda s, d: rounded(grid.infer_no_data(cells(s, d).withColumn("z", F.col("z") - 1000 * (1 + F.col("tile") % 2))), "no_data"),
        "ra6_spatial_lengths": lambda s, d: rounded(grid.d8_spatial(grid.d8_neighbours(cells(s, d))).select("tile", "row", "col", "dir", "length_3d"), "length_3d"),
        "mo8_pixel_info": lambda s, d: rounded(_pixel_info(s, d), "z", "gx", "gy"),
        **{f"ra8_{m}": _resampled(m) for m in METHODS},
    }


def _kernel_sql(method: str) -> str:
    def axis(old: str, n: str, m: str) -> str:
        new, ratio = f"to_{old}", f"(CAST({n} AS DOUBLE) / {m})"
        every = f"(SELECT *, unnest(range({n})) AS {old} FROM (SELECT *, unnest(range({m})) AS {new} FROM sizes))"
        if method == "nearest":
            return f"SELECT tile, {old}, {new}, 1.0 AS w FROM {every} WHERE {old} = floor(({new} + 0.5) * {ratio})"
        if method in ("average", "sum", "rms"):
            return f"SELECT * FROM (SELECT tile, {old}, {new}, least(({new} + 1) * {ratio}, {old} + 1) - greatest({new} * {ratio}, {old}) AS w FROM {every}) WHERE w > 1e-9"
        weight = {
            "bilinear": "greatest(0, 1 - t)",
            "cubic": "CASE WHEN t < 1 THEN 1.5 * t ** 3 - 2.5 * t ** 2 + 1 WHEN t < 2 THEN -0.5 * t ** 3 + 2.5 * t ** 2 - 4 * t + 2 ELSE 0 END",
            "spline": "CASE WHEN t < 1 THEN (3 * t ** 3 - 6 * t ** 2 + 4) / 6 WHEN t < 2 THEN (2 - t) ** 3 / 6 ELSE 0 END",
            "lanczos": "CASE WHEN t = 0 THEN 1 WHEN t < 3 THEN 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t) ** 2 ELSE 0 END",
        }[method]
        return f"SELECT * FROM (SELECT tile, {old}, {new}, {weight} AS w FROM (SELECT tile, {old}, {new}, abs({old} - (({new} + 0.5) * {ratio} - 0.5)) / greatest(1.0, {ratio}) AS t FROM {every})) WHERE w <> 0"

    z = {"sum": "sum(x.w * y.w * z)", "rms": "sqrt(sum(x.w * y.w * z * z) / sum(x.w * y.w))"}.get(method, "sum(x.w * y.w * z) / sum(x.w * y.w)")
    return f"""WITH {CELLS}, sizes AS (SELECT *, CAST(floor(n_rows * 3 / 5) + 1 AS BIGINT) AS m_rows, CAST(floor(n_cols * 13 / 10) AS BIGINT) AS m_cols FROM (SELECT tile, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM cells GROUP BY tile)),
wx AS ({axis("col", "n_cols", "m_cols")}), wy AS ({axis("row", "n_rows", "m_rows")}),
v AS (SELECT c.tile, to_row AS row, to_col AS col, {z} AS z FROM cells c JOIN wx x ON x.tile = c.tile AND x.col = c.col JOIN wy y ON y.tile = c.tile AND y.row = c.row GROUP BY ALL),
g AS (SELECT tile, row, unnest(range(m_cols)) AS col FROM (SELECT tile, m_cols, unnest(range(m_rows)) AS row FROM sizes))
SELECT tile, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(z, 6) + 0.0 AS z FROM g LEFT JOIN v USING (tile, row, col)"""


def oracle_sql() -> dict[str, str]:
    from scarpline.plans import queries as base

    files = f"{CELLS}, files AS (SELECT tile, row // {ROWS} AS r, col // {COLS} AS k, max(row) - row // {ROWS} * {ROWS} + 1 AS h, max(col) - col // {COLS} * {COLS} + 1 AS w FROM cells GROUP BY tile, row // {ROWS}, col // {COLS}), named AS (SELECT *, concat(tile, '_', r * {ROWS}, '_', k * {COLS}, '.tif') AS path, 100.0 + k * {COLS} AS x0, 40.0 - r * {ROWS} AS y1 FROM files)"
    mask = "m AS (SELECT r_regionkey AS id, 101.3 + r_regionkey * 4 AS a, 101.3 + r_regionkey * 4 + 2.4 AS b, 38.7 - r_regionkey * 2 - 3 AS c, 38.7 - r_regionkey * 2 AS d FROM region)"
    strips = f"{files}, {mask}, strips AS (SELECT path, tile, r, k, w, x0, i, y1 - i * {STRIP} AS top, y1 - least(h, (i + 1) * {STRIP}) AS low FROM (SELECT *, unnest(range((h + {STRIP - 1}) // {STRIP})) AS i FROM named)), met AS (SELECT s.*, EXISTS (SELECT 1 FROM m WHERE s.x0 <= m.b AND m.a <= s.x0 + s.w AND s.low <= m.d AND m.c <= s.top) AS needed FROM strips s)"
    # a block's cells without a part are null; files whose box meets no rectangle have no needed strip either
    grid = f"full_cells AS (SELECT tile, k, r, r * {ROWS} + i * {STRIP} + dr AS row, k * {COLS} + dc AS col FROM (SELECT *, unnest(range(w)) AS dc FROM (SELECT *, unnest(range(CAST(top - low AS BIGINT))) AS dr FROM met WHERE needed)))"
    return {
        "sc6_raster_cells": f"WITH {CELLS} SELECT tile, row, col, round(CAST(100.5 + col AS DOUBLE), 6) AS x, round(CAST(39.5 - row AS DOUBLE), 6) AS y, round(z, 6) AS z FROM cells",
        "sc7_raster_profiles": f"WITH {files} SELECT path, CAST(w AS INT) AS width, CAST(h AS INT) AS height, 1 AS bands, 'float64' AS dtype, round(CAST(-9999.0 AS DOUBLE), 6) AS no_data, {EPSG} AS epsg, round(CAST(x0 AS DOUBLE), 6) AS x_min, round(CAST(y1 - h AS DOUBLE), 6) AS y_min, round(CAST(x0 + w AS DOUBLE), 6) AS x_max, round(CAST(y1 AS DOUBLE), 6) AS y_max FROM named",
        "ra13_block_plan": f"WITH {strips} SELECT path, CAST(count(*) AS INT) AS blocks, CAST(count(*) FILTER (WHERE needed) AS INT) AS needed FROM met GROUP BY path",
        "ra13_import_grid": f"WITH {strips}, {grid}, p AS (SELECT g.tile, g.row, g.col, CAST(100.5 + g.col AS DOUBLE) AS x, CAST(39.5 - g.row AS DOUBLE) AS y, c.z FROM full_cells g LEFT JOIN cells c ON c.tile = g.tile AND c.row = g.row AND c.col = g.col) SELECT tile, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, EXISTS (SELECT 1 FROM m WHERE x >= a AND x < b AND y >= c AND y < d) AS inside FROM p",
        "co10_pick_cells": f"WITH {CELLS}, p AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS INT) AS tile, CAST((o_orderkey * 7) % 1100 AS INT) AS i FROM orders) SELECT id, p.tile, CAST(i // 50 AS INT) AS row, CAST(i % 50 AS INT) AS col, round(z, 6) + 0.0 AS z FROM p LEFT JOIN cells c ON c.tile = p.tile AND c.row = i // 50 AND c.col = i % 50",
        "co11_fake_coordinates": f"WITH {CELLS} SELECT tile, row, col, CAST(col AS DOUBLE) AS x, CAST(max(row) OVER (PARTITION BY tile) - row AS DOUBLE) AS y FROM cells",
        "pf9_ordered_grids": f"WITH {CELLS} SELECT tile, tile % 2 = 0 OR max(col) < 7 AS ordered FROM cells GROUP BY tile",
        "ag9_no_data": f"WITH {CELLS} SELECT tile, round(CASE WHEN min(z - 1000 * (1 + tile % 2)) < 0 THEN min(z - 1000 * (1 + tile % 2)) END, 6) AS no_data FROM cells GROUP BY tile",
        "ra6_spatial_lengths": f"WITH {base.NEIGHBOURS} SELECT tile, row, col, dir, round(sqrt(length * length + dz * dz), 6) AS length_3d FROM nb",
        "mo8_pixel_info": f"WITH {base.SLOPES}, s AS (SELECT *, max(row) OVER (PARTITION BY tile) - row AS up, (row * 50 + col) % 40 AS station FROM g) SELECT CAST(tile * 10 + col // 25 AS INT) AS area, tile, row, col, CAST(col AS DOUBLE) AS x, CAST(up AS DOUBLE) AS y, round(z, 6) AS z, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, CAST(station AS BIGINT) AS station, s_name AS name FROM s LEFT JOIN supplier ON s_suppkey = station",
        **{f"ra8_{m}": _kernel_sql(m) for m in METHODS},
    }
