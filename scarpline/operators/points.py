"""Points against grids, and interpolation between scattered stations at each time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.scratch import small

#: Distances held at a time where many targets meet many points.
PART = 2_000_000
#: Distances that stay in a core's cache.
CACHED = 32_768
#: How many squares around a target's own are searched for its triangle, then all.
REACHES = (1, 3, 12, None)


def bounding_box(cells: DataFrame) -> DataFrame:
    """CO-5: per tile the outer bounds of its cell centres (x, y): half a mean cell beyond them."""
    size = lambda v, n: (F.max(v) - F.min(v)) / F.nullif(F.countDistinct(n) - 1, F.lit(0)) / 2
    hx, hy = F.coalesce(size("x", "col"), F.lit(0.0)), F.coalesce(size("y", "row"), F.lit(0.0))
    return cells.groupBy("tile").agg((F.min("x") - hx).alias("x_min"), (F.max("x") + hx).alias("x_max"), (F.min("y") - hy).alias("y_min"), (F.max("y") + hy).alias("y_max"))


def grid_from_box(spark, x_min: float, x_max: float, y_min: float, y_max: float, cell: float, tile: int = 0) -> DataFrame:
    """CO-6: the cells (tile, row, col, x, y) of a regular grid over a box, rows from the top; made where they are used."""
    cols, rows = max(1, round((x_max - x_min) / cell)), max(1, round((y_max - y_min) / cell))
    k = F.col("id")
    row, col = F.floor(k / cols).cast("int"), F.pmod(k, F.lit(cols)).cast("int")
    dx, dy = (x_max - x_min) / cols, (y_max - y_min) / rows
    return spark.range(rows * cols).select(F.lit(tile).alias("tile"), row.alias("row"), col.alias("col"), (F.lit(x_min) + (col + 0.5) * dx).alias("x"), (F.lit(y_max) - (row + 0.5) * dy).alias("y"))


def nearest_cell(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """JN-2, JN-3: for each point (id, x, y) the nearest cell (tile, row, col, distance) of the tiles that hold it; else nulls.

    tiles: tile, x0, y0 (centre of the first cell), dx, dy (signed steps), rows, cols. On a regular grid the cell follows
    from the coordinates, so no cell table is read; of tiles as near, the least number counts.
    """
    col = F.floor((F.col("x") - F.col("x0")) / F.col("dx") + 0.5)
    row = F.floor((F.col("y") - F.col("y0")) / F.col("dy") + 0.5)
    kept = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.col(n) - 1).cast("int")
    fx, fy = (F.col("x") - F.col("x0")) / F.col("dx"), (F.col("y") - F.col("y0")) / F.col("dy")
    inside = fx.between(-0.5, F.col("cols") - 0.5) & fy.between(-0.5, F.col("rows") - 0.5)
    # tiles and points meet by squares as large as the largest tile, of which a tile touches four at most
    edge = lambda o, step, n: (F.col(o) - F.col(step) / 2, F.col(o) + (F.col(n) - 0.5) * F.col(step))
    ends = {k: edge(*v) for k, v in {"bx": ("x0", "dx", "cols"), "by": ("y0", "dy", "rows")}.items()}
    side = tiles.agg(*[F.max(F.abs(b - a)) for a, b in ends.values()]).first()
    side = max(1e-12, side[0] or 0.0, side[1] or 0.0)
    touched = lambda a, b: F.sequence(F.floor(F.least(a, b) / side - 1e-9), F.floor(F.greatest(a, b) / side + 1e-9))
    spread = tiles.withColumn("bx", F.explode(touched(*ends["bx"]))).withColumn("by", F.explode(touched(*ends["by"])))
    keyed = points.select("id", "x", "y", F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"))
    met = keyed.join(spread, ["bx", "by"]).filter(inside).withColumns({"row": kept(row, "rows"), "col": kept(col, "cols")})
    d = F.sqrt((F.col("x") - F.col("x0") - F.col("col") * F.col("dx")) ** 2 + (F.col("y") - F.col("y0") - F.col("row") * F.col("dy")) ** 2)
    best = met.groupBy("id").agg(F.min(F.struct(d.alias("distance"), "tile", "row", "col")).alias("m"))
    return points.join(best, "id", "left").select(*points.columns, "m.tile", "m.row", "m.col", "m.distance")


def nearest_by_steps(targets: DataFrame, stations: DataFrame, cell: float = 0.1) -> DataFrame:
    """IN-1: for each target (id, x, y) the station of least |dx| + |dy|, of equals the least; by squares of side cell, see nearest."""
    from scarpline.operators.neighbours import nearest

    refs = stations.select(F.col("station").alias("ref"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return nearest(targets, refs, cell, by_steps=True).select("id", F.col("ref").alias("station"), "distance")


def _cholesky(columns, n: int, block: int = 256) -> list[np.ndarray]:
    """The lower factor of a positive definite matrix, in panels: the k-th has the columns from k * block on, and of these the rows from there on.

    columns(lo, hi) makes the rows from lo on of the columns lo to hi, so the matrix itself is not held.
    """
    panels: list[np.ndarray] = []
    for lo in range(0, n, block):
        own = columns(lo, min(n, lo + block))
        wide = own.shape[1]
        for k, panel in enumerate(panels):
            rows = panel[lo - k * block :]
            own -= rows @ rows[:wide].T
        own[:wide] = np.linalg.cholesky(own[:wide])
        own[wide:] = own[wide:] @ np.linalg.inv(own[:wide]).T
        panels.append(own)
    return panels


def _substituted(panels: list[np.ndarray], right) -> np.ndarray:
    """Solves for the columns of right with the factor that the panels are."""
    x, at = right.copy(), np.cumsum([0] + [p.shape[1] for p in panels])
    for p, lo, hi in zip(panels, at, at[1:]):
        x[lo:hi] = np.linalg.solve(p[: hi - lo], x[lo:hi])
        x[hi:] -= p[hi - lo :] @ x[lo:hi]
    for p, lo, hi in reversed(list(zip(panels, at, at[1:]))):
        x[lo:hi] = np.linalg.solve(p[: hi - lo].T, x[lo:hi] - p[hi - lo :].T @ x[hi:])
    return x


def _radial(x, y, v, tx, ty):
    """Multiquadric interpolation; its scale is the mean spacing of the points in their box. Points of one place count as one with their mean.

    Between differences of weights the negative matrix is positive definite, so half of one factor is all that is held; the targets are looked up in parts.
    """
    sides = np.array([np.ptp(x), np.ptp(y)])
    sides = sides[sides > 0]
    scale = (np.prod(sides) / len(x)) ** (1 / len(sides)) if len(sides) else 1.0
    places, of = np.unique(np.stack([x, y]), axis=1, return_inverse=True)
    if places.shape[1] < len(x):  # which is what least squares make of them
        x, y, v = *places, np.bincount(of.ravel(), v) / np.bincount(of.ravel())
    first = np.argmin((x - x.mean()) ** 2 + (y - y.mean()) ** 2)
    order = np.r_[first, np.delete(np.arange(len(x)), first)]
    tx, ty = (tx - x[first]) / scale, (ty - y[first]) / scale
    x, y, v = (x[order] - x[first]) / scale, (y[order] - y[first]) / scale, v[order]
    n = len(x)

    def phi(ax, ay, x=x, y=y):
        out, dy = ax[:, None] - x, ay[:, None] - y
        out *= out
        dy *= dy
        out += dy
        out += 1
        return np.sqrt(out, out=out)

    def summed(ax, ay, weights):
        step = max(1, CACHED // n)
        return np.concatenate([phi(ax[lo : lo + step], ay[lo : lo + step]) @ weights for lo in range(0, len(ax), step)] or [np.empty(0)])

    far = phi(x[:1], y[:1])[0]
    g = far[1:] - 1

    def columns(lo, hi):
        of = slice(lo + 1, hi + 1)
        out = phi(x[lo + 1 :], y[lo + 1 :], x[of], y[of])
        np.subtract(far[of] - 1, out, out=out)
        out += far[lo + 1 :, None]
        return out

    def solved(right):
        """Weights w: w[0] is what the others, which are found first, leave of their sum."""
        q = _substituted(panels, right[1:] - right[0])
        total = (right[0] + g @ q) / (1 + g @ p)
        w = total * p - q
        return np.r_[total - w.sum(), w]

    try:
        panels = _cholesky(columns, n - 1)
        p = _substituted(panels, g)
        weights, left = np.zeros(n), v
        for _ in range(4):
            more = weights + solved(left)
            rest = v - summed(x, y, more)
            if not np.abs(rest).max() < np.abs(left).max():
                break
            weights, left = more, rest
        good = np.abs(left).max() <= 1e-8 * max(1.0, np.abs(v).max())
    except np.linalg.LinAlgError:
        good = False
    if not good:  # places that lie too close for their numbers
        weights = np.linalg.lstsq(phi(x, y), v, rcond=None)[0]
    return summed(tx, ty, weights)


def _hull(x, y):
    """The corners of the convex hull of points, counter-clockwise."""
    order = np.lexsort((y, x))
    turn = lambda o, a, b: (x[a] - x[o]) * (y[b] - y[o]) - (y[a] - y[o]) * (x[b] - x[o])
    halves = []
    for run in (order, order[::-1]):
        half: list[int] = []
        for p in run:
            while len(half) > 1 and turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def _settle(corner, weight, px, py, x, y):
    """Turns triangles (corner, numbers of points) around places, whose barycentric weights are given, until no point lies under their lifted planes.

    The place stays inside: of the triangle and the point that lies lowest under its plane, the corner goes whose loss keeps all weights positive.
    """
    lift = x * x + y * y
    least = -1e-11 * max(lift.max(), 1e-300)
    busy = np.arange(len(px))
    for _ in range(10 * len(x) + 100):
        i, j, k = corner[busy].T
        ax, ay, bx, by = x[j] - x[i], y[j] - y[i], x[k] - x[i], y[k] - y[i]
        d = ax * by - ay * bx
        la, lb = lift[j] - lift[i], lift[k] - lift[i]
        gx, gy = (la * by - lb * ay) / d, (lb * ax - la * bx) / d
        under = lift - gx[:, None] * x - gy[:, None] * y - (lift[i] - gx * x[i] - gy * y[i])[:, None]
        np.put_along_axis(under, corner[busy], 0.0, 1)
        low = under.argmin(1)
        more = under[np.arange(len(busy)), low] < least
        if not more.any():
            return
        busy, low = busy[more], low[more]
        i, d, ax, ay, bx, by = (c[more] for c in (i, d, ax, ay, bx, by))
        ox, oy = x[low] - x[i], y[low] - y[i]
        share = np.stack([np.zeros(len(busy)), (ox * by - oy * bx) / d, (ax * oy - ay * ox) / d], 1)
        share[:, 0] = 1 - share[:, 1] - share[:, 2]
        own = weight[busy]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(share > 1e-12, np.maximum(own, 0.0) / share, np.inf)
        least_ratio = ratio.min(1)
        goes = np.where(ratio <= least_ratio[:, None] + 1e-12, share, -np.inf).argmax(1)
        at = np.arange(len(busy))
        part = ratio[at, goes]
        own = own - part[:, None] * share
        own[at, goes] = part
        weight[busy], corner[busy, goes] = own, low


def _linear(x, y, v, tx, ty, near: int = 4):
    """On the Delaunay triangle around each target, NaN outside of the hull.

    Each target begins in a triangle of the hull's corners and turns it until no point lies under its lifted plane, first among the points of the squares
    around its own, of about `near` points each, then, unless the circle through the corners lies in these squares, among all points.
    """
    out = np.full(len(tx), np.nan)
    hull = _hull(x, y) if len(x) > 2 else ()
    if len(hull) < 3:
        return out
    inside = np.ones(len(tx), bool)
    for p, q in zip(hull, np.roll(hull, -1)):
        inside &= (x[q] - x[p]) * (ty - y[p]) - (y[q] - y[p]) * (tx - x[p]) >= -1e-9
    todo = np.flatnonzero(inside)
    if not len(todo):
        return out
    # the triangle of the first corner and two neighbouring ones whose weights are least negative
    best, corner, weight = np.full(len(todo), -np.inf), np.zeros((len(todo), 3), int), np.zeros((len(todo), 3))
    o = hull[0]
    for p, q in zip(hull[1:], hull[2:]):
        d = (x[p] - x[o]) * (y[q] - y[o]) - (x[q] - x[o]) * (y[p] - y[o])
        b = ((tx[todo] - x[o]) * (y[q] - y[o]) - (x[q] - x[o]) * (ty[todo] - y[o])) / d
        c = ((x[p] - x[o]) * (ty[todo] - y[o]) - (tx[todo] - x[o]) * (y[p] - y[o])) / d
        w = np.stack([1 - b - c, b, c], 1)
        m = w.min(1)
        new = m > best
        best[new], corner[new], weight[new] = m[new], (o, p, q), w[new]
    side = max((np.ptp(x) * np.ptp(y) * near / len(x)) ** 0.5, 1e-12)
    x0, y0 = x.min(), y.min()
    rows = int(np.ptp(y) // side) + 4
    column, row = (lambda c: ((c - x0) // side).astype(int) + 1), (lambda c: ((c - y0) // side).astype(int) + 1)
    order = np.argsort(column(x) * rows + row(y), kind="stable")
    codes = (column(x) * rows + row(y))[order]
    squares = column(tx[todo]) * rows + row(ty[todo])
    by_square = np.argsort(squares, kind="stable")
    starts = np.r_[np.flatnonzero(np.diff(squares[by_square], prepend=squares.min() - 1)), len(by_square)]
    for a, b in zip(starts, starts[1:]):
        mine = by_square[a:b]
        code = squares[mine[0]]
        cx, cy = x0 + (code // rows - 0.5) * side, y0 + (code % rows - 0.5) * side
        part = mine
        for reach in REACHES:
            if reach is None:
                of = np.arange(len(x))
            else:
                below, above = max(0, code % rows - reach), min(rows - 1, code % rows + reach)
                strips = (code // rows + np.arange(-reach, reach + 1)) * rows
                ranges = zip(np.searchsorted(codes, strips + below).tolist(), np.searchsorted(codes, strips + above, "right").tolist())
                of = np.unique(np.concatenate([order[lo:hi] for lo, hi in ranges] + [corner[part].ravel()]))
            step = max(1, PART // len(of))
            for lo in range(0, len(part), step):
                p = part[lo : lo + step]
                local, w = np.searchsorted(of, corner[p]), weight[p]
                _settle(local, w, tx[todo[p]] - cx, ty[todo[p]] - cy, x[of] - cx, y[of] - cy)
                corner[p], weight[p] = of[local], w
            # the circles of those that may reach beyond the squares
            i, j, k = corner[part].T
            ax, ay, bx, by = x[j] - x[i], y[j] - y[i], x[k] - x[i], y[k] - y[i]
            d = 2 * (ax * by - ay * bx)
            la, lb = ax * ax + ay * ay, bx * bx + by * by
            ux, uy = (by * la - ay * lb) / d, (ax * lb - bx * la) / d
            beyond = np.maximum(np.abs(x[i] + ux - cx), np.abs(y[i] + uy - cy)) + np.hypot(ux, uy)
            part = part[beyond > ((reach or 0) + 0.5) * side]
            if not len(part):
                break
    out[todo] = (weight * v[corner]).sum(1)
    return out


def interpolate(series: DataFrame, stations: DataFrame, method: str = "linear") -> DataFrame:
    """IN-2, IN-4: nulls of (station, ts, value) from the stations (station, x, y) with a value at that time; linear or rbf.

    One task holds the stations of one time; times are spread over the cluster. A gap
    outside of the hull of the stations stays null with linear, as does any gap of a time without values. A series whose station has no
    place stays as it is, and fills no other.
    """
    kernel = {"linear": _linear, "rbf": _radial}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        placed = (pdf["x"].notna() & pdf["y"].notna()).to_numpy()
        has = pdf["value"].notna().to_numpy() & placed
        none = pdf["value"].isna().to_numpy() & placed
        if has.any() and none.any():
            own, gap = pdf[has], pdf[none]
            pdf.loc[none, "value"] = kernel(*(own[c].to_numpy(float) for c in ("x", "y", "value")), *(gap[c].to_numpy(float) for c in "xy"))
        return pdf[["station", "ts", "value"]]

    met = series.select("station", "ts", F.col("value").cast("double").alias("value")).join(small(stations.select("station", "x", "y")), "station", "left")
    fields = ", ".join(f"`{n}` {t}" for n, t in met.select("station", "ts", "value").dtypes)
    # a time is few bytes, but much work: tasks are not merged by their bytes
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(tasks, "ts").groupBy("ts").applyInPandas(run, fields)
    return found.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
