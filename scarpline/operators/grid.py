"""Grids as long cell tables (tile, row, col, z): gradients, morphology, neighbours, resampling, painting, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The eight neighbours in the order E, SE, S, SW, W, NW, N, NE as (row, col) steps.
D8 = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _gradient(z: str, along: str, across: str, spacing: float) -> Column:
    """Central differences inside, one-sided ones at the ends; null where a value that it needs is missing."""
    order = Window.partitionBy("tile", across).orderBy(along)
    here, before, after = F.col(z), F.lag(z).over(order), F.lead(z).over(order)
    has_before, has_after = F.lag(along).over(order).isNotNull(), F.lead(along).over(order).isNotNull()
    return F.when(has_before & has_after, (after - before) / (2 * spacing)).when(has_after, (after - here) / spacing).when(has_before, (here - before) / spacing)


def gradients(cells: DataFrame, dx: float = 1.0, dy: float = 1.0, z: str = "z", names: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """RA-1: slopes along columns and rows. No-data is null and makes its neighbours' slopes null."""
    return cells.withColumn(names[0], _gradient(z, "col", "row", dx)).withColumn(names[1], _gradient(z, "row", "col", dy))


def slope_aspect(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """RA-2: slope in degrees, and aspect as the angle of (gx, -gy), counter-clockwise from east."""
    g = gradients(cells, dx, dy)
    return g.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)))).withColumn("aspect", F.pmod(F.degrees(F.atan2(-F.col("gy"), F.col("gx"))) + 360, F.lit(360.0)))


def curvatures(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """RA-3: profile, planform and twisting curvature from slopes of slopes."""
    g = gradients(cells, dx, dy)
    g = gradients(gradients(g, dx, dy, "gx", ("r", "s")), dx, dy, "gy", ("_", "t")).drop("_")
    p, q, r, s, t = (F.col(c) for c in ("gx", "gy", "r", "s", "t"))
    d = p * p + q * q + 1e-10
    return g.withColumns({"profile": (r * p * p + 2 * s * p * q + t * q * q) / d, "planform": (r * q * q - 2 * s * p * q + t * p * p) / d, "twisting": (r * p * q + s * (p * p - q * q) - t * p * q) / d}).drop("r", "s", "t")


def d8_neighbours(cells: DataFrame, step: int = 1, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """RA-5, RA-6: rows (tile, row, col, dir, n_row, n_col, dz, length, slope) of the neighbours inside of the grid."""
    around = F.array(*[F.struct(F.lit(k).alias("dir"), F.lit(r * step).alias("dr"), F.lit(c * step).alias("dc")) for k, (r, c) in enumerate(D8)])
    out = cells.select("tile", "row", "col", "z", F.explode(around).alias("d")).select("tile", "row", "col", "z", "d.dir", (F.col("row") + F.col("d.dr")).cast("int").alias("n_row"), (F.col("col") + F.col("d.dc")).cast("int").alias("n_col"), F.sqrt((F.col("d.dr") * dy) ** 2 + (F.col("d.dc") * dx) ** 2).alias("length"))
    there = cells.select("tile", F.col("row").cast("int").alias("n_row"), F.col("col").cast("int").alias("n_col"), F.col("z").alias("n_z"))
    dz = F.col("n_z") - F.col("z")
    return out.join(there, ["tile", "n_row", "n_col"]).select("tile", "row", "col", "dir", "n_row", "n_col", dz.alias("dz"), "length", (dz / F.col("length")).alias("slope"))


def point_gradients(cells: DataFrame, reach: int = 1, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """RA-7: central differences at +-reach; null within reach + 1 cells of an edge."""
    size = cells.groupBy("tile").agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    along, down = Window.partitionBy("tile", "row").orderBy("col"), Window.partitionBy("tile", "col").orderBy("row")
    inner = lambda i, n: (F.col(i) - reach > 0) & (F.col(i) + reach < F.col(n))
    gx = F.when(inner("col", "_cols") & inner("row", "_rows"), (F.lead("z", reach).over(along) - F.lag("z", reach).over(along)) / (2 * reach * dx))
    gy = F.when(inner("col", "_cols") & inner("row", "_rows"), (F.lead("z", reach).over(down) - F.lag("z", reach).over(down)) / (2 * reach * dy))
    return cells.join(F.broadcast(size), "tile").withColumns({"gx": gx, "gy": gy}).drop("_rows", "_cols")


def resample(cells: DataFrame, k: int, how: str = "average") -> DataFrame:
    """RA-8: blocks of k by k cells into one."""
    agg = {"average": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "mode": lambda c: F.mode(c, True), "q1": lambda c: F.percentile(c, 0.25), "q3": lambda c: F.percentile(c, 0.75), "rms": lambda c: F.sqrt(F.avg(F.col(c) ** 2))}[how]
    return cells.groupBy("tile", F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(agg("z").alias("z"))


def paint(cells: DataFrame, burns: DataFrame, no_data=None) -> DataFrame:
    """RA-10: value of the burn (tile, row, col, priority, value) of least priority number in each cell, else no_data."""
    first = burns.groupBy("tile", "row", "col").agg(F.min_by("value", "priority").alias("value"))
    return cells.join(first, ["tile", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(no_data)))


def mask(cells: DataFrame, kept: DataFrame, no_data: float = 0.0) -> DataFrame:
    """CO-9: z outside of the kept cells becomes no_data."""
    hit = kept.select("tile", "row", "col").distinct().withColumn("_in", F.lit(True))
    return cells.join(hit, ["tile", "row", "col"], "left").withColumn("z", F.when(F.col("_in"), F.col("z")).otherwise(no_data)).drop("_in")


def cells_in_polygons(cells: DataFrame, edges: DataFrame, band: float = 1.0) -> DataFrame:
    """JN-4: (tile, row, col, poly_id) of cells (x, y) inside of polygons, by crossings of a ray to the right.

    edges: poly_id, x1, y1, x2, y2 of closed rings. Cells and edges meet by equal bands of y, of the given height, so the
    join is one on equal keys; of these only edges that the ray crosses are counted.
    """
    box = edges.groupBy("poly_id").agg(F.least(F.min("x1"), F.min("x2")).alias("xa"), F.greatest(F.max("x1"), F.max("x2")).alias("xb"))
    at = lambda v: F.floor(v / band)
    spread = edges.filter("y1 <> y2").join(box, "poly_id").withColumn("_band", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    met = cells.select("tile", "row", "col", "x", "y", at(F.col("y")).alias("_band")).join(spread, "_band").filter(F.col("x").between(F.col("xa"), F.col("xb")) & crossing)
    return met.groupBy("tile", "row", "col", "poly_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def cells_touched(cells: DataFrame, edges: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """RA-12: (tile, row, col, poly_id) of cells of which any part, not only the centre, lies in a polygon.

    A side touches a cell if their boxes meet and not all corners of the cell lie on one side of its line.
    """
    at = lambda v: F.floor(v / height)
    spread = edges.withColumn("_band", F.explode(F.sequence(at(F.least("y1", "y2")) - 1, at(F.greatest("y1", "y2")) + 1)))
    met = cells.select("tile", "row", "col", "x", "y", at(F.col("y")).alias("_band")).join(spread, "_band")
    hx, hy = width / 2, height / 2
    boxes = (F.col("x") + hx >= F.least("x1", "x2")) & (F.col("x") - hx <= F.greatest("x1", "x2")) & (F.col("y") + hy >= F.least("y1", "y2")) & (F.col("y") - hy <= F.greatest("y1", "y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = dx * (F.col("y") - F.col("y1")) - dy * (F.col("x") - F.col("x1"))
    touched = met.filter(boxes & (F.abs(side) <= F.abs(dx) * hy + F.abs(dy) * hx)).select("tile", "row", "col", "poly_id")
    return touched.union(cells_in_polygons(cells, edges, height)).distinct()


def class_parameters(cells: DataFrame, covered: DataFrame, classes: DataFrame, parameters: list[str], no_data=None) -> DataFrame:
    """RA-11, JN-9: the parameters of each cell's class: covered (tile, row, col, priority, class_id), the least priority number first."""
    first = covered.groupBy("tile", "row", "col").agg(F.min_by("class_id", "priority").alias("class_id"))
    met = cells.join(first, ["tile", "row", "col"], "left").join(classes.select("class_id", *parameters), "class_id", "left")
    return met.withColumns({p: F.coalesce(p, F.lit(no_data)) for p in parameters}) if no_data is not None else met


def infer_no_data(cells: DataFrame, stated: float | None = None) -> DataFrame:
    """AG-9: per tile (tile, no_data): the stated value, or else the smallest z if that is negative, or else null."""
    least = F.min("z")
    return cells.groupBy("tile").agg((F.lit(float(stated)) if stated is not None else F.when(least < 0, least)).cast("double").alias("no_data"))


def pick_cells(cells: DataFrame, picks: DataFrame, width: int) -> DataFrame:
    """CO-10: for each pick (id, tile, idx_1d) the cell of that row-major index: id, tile, row, col, z; null where there is none."""
    from scarpline.functions.scalars import row_col

    row, col = row_col(F.col("idx_1d"), width)
    return picks.withColumns({"row": row, "col": col}).join(cells.select("tile", "row", "col", "z"), ["tile", "row", "col"], "left").select("id", "tile", "row", "col", "z")


def fake_coordinates(cells: DataFrame) -> DataFrame:
    """CO-11: adds x and y for tiles without any: x the column, y the row counted upwards from the last one."""
    last = cells.groupBy("tile").agg(F.max("row").alias("_last"))
    return cells.join(last, "tile").withColumns({"x": F.col("col").cast("double"), "y": (F.col("_last") - F.col("row")).cast("double")}).drop("_last")


def grids_ordered(cells: DataFrame) -> DataFrame:
    """PF-9: per tile (tile, ordered): whether x goes one way along all its rows, and y one way along all its columns."""
    along, down = Window.partitionBy("tile", "row").orderBy("col"), Window.partitionBy("tile", "col").orderBy("row")
    steps = cells.select("tile", (F.col("x") - F.lag("x").over(along)).alias("dx"), (F.col("y") - F.lag("y").over(down)).alias("dy"))
    one_way = lambda c: F.coalesce(F.every(F.coalesce(F.col(c) >= 0, F.lit(True))), F.lit(True)) | F.coalesce(F.every(F.coalesce(F.col(c) <= 0, F.lit(True))), F.lit(True))
    return steps.groupBy("tile").agg((one_way("dx") & one_way("dy")).alias("ordered"))


def d8_spatial(neighbours: DataFrame) -> DataFrame:
    """RA-6: adds length_3d, the length along the slope, to d8_neighbours()."""
    return neighbours.withColumn("length_3d", F.hypot("length", "dz"))


def pixel_info(pixels: DataFrame, cells: DataFrame, stations: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """MO-8: pixels (area, tile, row, col, station) with x, y and z, slopes gx and gy, and the name of their station (station, name)."""
    own = gradients(cells.select("tile", "row", "col", "x", "y", "z"), dx, dy)
    return pixels.join(own, ["tile", "row", "col"], "left").join(stations.select("station", "name"), "station", "left").select("area", "tile", "row", "col", "x", "y", "z", "gx", "gy", "station", "name")
