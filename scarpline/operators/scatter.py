"""RA-9: scattered values on the cells of a grid, by the nearest point or linear on the triangles of Delaunay.

Cells and points meet in squares, points also in the squares around theirs. A triangle is certain if no point of a square's
neighbourhood lies in the circle through its corners and the circle lies in the neighbourhood; cells without a certain triangle meet again in squares of
twice the side, so a task holds the points of nine squares. Cells outside of the hull of all points, which is made of the squares' hulls, go first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.neighbours import nearest
from scarpline.operators.points import _hull
from scarpline.operators.scratch import checkpointed

NEAR = 8


def _corner_hull(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y = pdf["px"].to_numpy(float), pdf["py"].to_numpy(float)
    own = _hull(x, y) if len(x) > 2 else np.arange(len(x))
    return pd.DataFrame({"px": x[own], "py": y[own]})


def _hull_of(points: DataFrame, side: float) -> np.ndarray:
    """The corners of the hull of all points, counter-clockwise: those of the squares' hulls first, so few reach the last task."""
    square = [F.floor(F.col(c) / (8 * side)).alias(f"_{c}") for c in ("px", "py")]
    some = points.select("px", "py", *square).groupBy("_px", "_py").applyInPandas(_corner_hull, "px double, py double")
    found = some.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_corner_hull, "px double, py double").toPandas()
    return found.to_numpy(float)


def _triangle(tx: float, ty: float, x, y, box) -> tuple[np.ndarray, np.ndarray] | None:
    """(corners, weights) of the Delaunay triangle around a place if it is certain among these points."""
    order = np.argsort((x - tx) ** 2 + (y - ty) ** 2, kind="stable")
    n = min(NEAR, len(x))
    while True:
        some = order[:n]
        i, j, k = some[np.array(list(combinations(range(n), 3)))].T
        d = (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])
        i, j, k, d = (v[np.abs(d) > 1e-12] for v in (i, j, k, d))
        b = ((tx - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (ty - y[i])) / d
        c = ((x[j] - x[i]) * (ty - y[i]) - (tx - x[i]) * (y[j] - y[i])) / d
        held = np.flatnonzero((1 - b - c >= -1e-9) & (b >= -1e-9) & (c >= -1e-9))
        if len(held):
            i, j, k, d, b, c = (v[held] for v in (i, j, k, d, b, c))
            # from the place, so that squares stay small
            ax, ay, bx, by, cx, cy = x[i] - tx, y[i] - ty, x[j] - tx, y[j] - ty, x[k] - tx, y[k] - ty
            la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            ux = (la * (by - cy) + lb * (cy - ay) + lc * (ay - by)) / (2 * d)
            uy = (la * (cx - bx) + lb * (ax - cx) + lc * (bx - ax)) / (2 * d)
            radius = np.hypot(ax - ux, ay - uy)
            # the circle without points reaches least beyond the place, as do others through the side on which the place lies, if it does
            reach = radius**2 - ux**2 - uy**2
            least = np.flatnonzero(reach <= reach.min() + 1e-9 * (abs(reach.min()) + (la + lb + lc).min()))
            empty = [at for at in least if ((x - tx - ux[at]) ** 2 + (y - ty - uy[at]) ** 2 >= radius[at] ** 2 * (1 - 1e-9)).all()]
            if empty:
                at = empty[0]
                left, right, low, high = box
                inside = tx + ux[at] - radius[at] >= left and tx + ux[at] + radius[at] <= right and ty + uy[at] - radius[at] >= low and ty + uy[at] + radius[at] <= high
                return (np.array([i[at], j[at], k[at]]), np.array([1 - b[at] - c[at], b[at], c[at]])) if inside else None
        if n >= len(x):
            return None
        n = min(2 * n, len(x))


def _in_square(key: list[str], side: float, whole: bool):
    """Looks up the cells of one square among the points of its neighbourhood, or among all points."""

    def run(square, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = square
        near = pdf[~pdf["_cell"]]
        x, y, v = (near[c].to_numpy(float) for c in ("x", "y", "v"))
        box = (-np.inf, np.inf, -np.inf, np.inf) if whole else ((i - 1) * side, (i + 2) * side, (j - 1) * side, (j + 2) * side)
        mine = pdf[pdf["_cell"]].copy()
        out = [_triangle(tx, ty, x, y, box) if len(x) > 2 else None for tx, ty in zip(mine["x"], mine["y"])]
        mine["value"] = [np.nan if t is None else float(v[t[0]] @ t[1]) for t in out]
        mine["known"] = [t is not None or whole for t in out]
        return mine[[*key, "x", "y", "value", "known"]]

    return run


def _in_hull(hull: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for (ax, ay), (bx, by) in zip(hull, np.roll(hull, -1, 0)):
        out &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 * max(1.0, np.hypot(bx - ax, by - ay))
    return out


def linear_on_cells(cells: DataFrame, points: DataFrame, side: float) -> DataFrame:
    """Cells (tile, row, col, x, y) with value, linear on the Delaunay triangles of points (px, py, v); null outside of their hull.

    Points of equal place count as one with their mean. side: that of the first squares, of about some points each.
    """
    key = ["tile", "row", "col"]
    own = checkpointed(points.filter("px IS NOT NULL AND py IS NOT NULL AND v IS NOT NULL").groupBy("px", "py").agg(F.avg("v").alias("v")))
    bounds = own.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count("*")).first()
    if not bounds[4]:
        return cells.withColumn("value", F.lit(None).cast("double"))
    hull = _hull_of(own, side)
    span = max(bounds[1] - bounds[0], bounds[3] - bounds[2])

    def inside(batches):
        for pdf in batches:
            yield pdf[_in_hull(hull, pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))] if len(hull) > 2 else pdf.iloc[:0]

    rest = checkpointed(cells.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(inside, ", ".join(f"`{n}` {t}" for n, t in cells.select(*key).dtypes) + ", x double, y double"))
    found = []
    while not rest.isEmpty():
        whole = side > span
        at = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        there = own.select("px", "py", "v", around.alias("s")).select((at("px") + F.col("s.i")).alias("_i"), (at("py") + F.col("s.j")).alias("_j"), F.lit(False).alias("_cell"), F.col("px").alias("x"), F.col("py").alias("y"), "v")
        both = rest.withColumns({"_i": at("x"), "_j": at("y"), "_cell": F.lit(True)}).unionByName(there, allowMissingColumns=True)
        kinds = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
        tried = checkpointed(both.groupBy("_i", "_j").applyInPandas(_in_square(key, side, whole), f"{kinds}, value double, known boolean"))
        found.append(tried.filter("known").select(*key, F.nanvl("value", F.lit(None).cast("double")).alias("value")))
        rest = tried.filter("NOT known").select(*rest.columns)
        side *= 2
    out = found[0] if found else rest.select(*key, F.lit(None).cast("double").alias("value"))
    for more in found[1:]:
        out = out.union(more)
    return cells.join(out, key, "left")


def scatter_to_grid(cells: DataFrame, points: DataFrame, method: str = "linear", side: float = 1.0, max_distance: float | None = None) -> DataFrame:
    """RA-9: cells (tile, row, col, x, y) with value from points (px, py, v), nearest or linear; null farther than max_distance from every point."""
    own = points.filter("px IS NOT NULL AND py IS NOT NULL AND v IS NOT NULL")
    refs = own.groupBy("px", "py").agg(F.avg("v").alias("v")).select(F.struct("px", "py", "v").alias("ref"), F.col("px").alias("rx"), F.col("py").alias("ry"))
    met = None
    if method == "nearest" or max_distance is not None:
        met = nearest(cells.select(F.struct("tile", "row", "col").alias("id"), "x", "y"), refs, side).select("id.tile", "id.row", "id.col", F.col("ref.v").alias("_v"), "distance")
    if method == "nearest":
        out = cells.join(met, ["tile", "row", "col"], "left").withColumnRenamed("_v", "value")
    else:
        out = linear_on_cells(cells, own, side)
        out = out if met is None else out.join(met.drop("_v"), ["tile", "row", "col"], "left")
    if max_distance is not None:
        out = out.withColumn("value", F.when(F.col("distance") <= max_distance, F.col("value")))
    return out.select(*cells.columns, "value")
