"""RA-8 at any ratio: nearest, bilinear, cubic, spline and Lanczos kernels, and averages by shared area.

A kernel is a product of weights along columns and along rows, so cells are first joined with the weights of their column, summed by row
and new column, then with those of their row. A join finds a cell's neighbours wherever they are, so tiles of tasks need no margins.
Cells without a value take no part, and the weights of the others are scaled up to one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _piecewise(t: Column, near, far) -> Column:
    return F.when(t < 1, near(t)).when(t < 2, far(t)).otherwise(0.0)


def _sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / F.nullif(math.pi * x, F.lit(0.0)))


#: Radius and weight by distance (not negative) of each kernel.
KERNELS: dict[str, tuple[float, Callable[[Column], Column]]] = {
    "bilinear": (1.0, lambda t: F.greatest(F.lit(0.0), 1 - t)),
    "cubic": (2.0, lambda t: _piecewise(t, lambda t: 1.5 * t**3 - 2.5 * t**2 + 1, lambda t: -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2)),
    "spline": (2.0, lambda t: _piecewise(t, lambda t: (3 * t**3 - 6 * t**2 + 4) / 6, lambda t: (2 - t) ** 3 / 6)),
    "lanczos": (3.0, lambda t: F.when(t < 3, _sinc(t) * _sinc(t / 3)).otherwise(0.0)),
}


def _axis(sizes: DataFrame, old: str, new: str, method: str) -> DataFrame:
    """Weights (tile, old, new, w) along one axis of `old` cells for as many new ones as sizes (tile, n, m) says."""
    ratio = F.col("n") / F.col("m")
    each = sizes.withColumn(new, F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    keep = lambda a, b: F.explode(F.sequence(F.greatest(F.lit(0), a.cast("int")), F.least(F.col("n") - 1, b.cast("int"))))
    if method == "nearest":
        out = each.withColumns({old: F.floor((F.col(new) + 0.5) * ratio).cast("int"), "w": F.lit(1.0)})
    elif method in ("average", "sum", "rms"):
        low, high = F.col(new) * ratio, (F.col(new) + 1) * ratio
        spread = each.withColumn(old, keep(F.floor(low), F.floor(high)))
        out = spread.withColumn("w", F.least(high, F.col(old) + 1) - F.greatest(low, F.col(old).cast("double"))).filter("w > 1e-9")
    else:
        radius, weight = KERNELS[method]
        centre, wide = (F.col(new) + 0.5) * ratio - 0.5, F.greatest(F.lit(1.0), ratio)
        spread = each.withColumn(old, keep(F.ceil(centre - radius * wide), F.floor(centre + radius * wide)))
        out = spread.withColumn("w", weight(F.abs(F.col(old) - centre) / wide)).filter("w <> 0")
    return out.select("tile", old, new, "w")


def resample_cells(cells: DataFrame, sizes: DataFrame, method: str) -> DataFrame:
    """Cells (tile, row, col, z) of a grid of other sizes (tile, rows, cols, new_rows, new_cols) over the same extent.

    Methods: nearest, bilinear, cubic, spline, lanczos, and average, sum and rms by shared area. A cell whose neighbours have no value, or
    whose weights cancel, is null.
    """
    of = lambda n, m: sizes.select("tile", F.col(n).cast("int").alias("n"), F.col(m).cast("int").alias("m"))
    across, down = _axis(of("cols", "new_cols"), "col", "to_col", method), _axis(of("rows", "new_rows"), "row", "to_row", method)
    value = F.col("z") ** 2 if method == "rms" else F.col("z")
    own = cells.select("tile", "row", "col", value.alias("z")).filter(F.col("z").isNotNull())
    sums = lambda a, b: [F.sum(F.col("w") * a).alias("a"), F.sum(F.col("w") * b).alias("b")]
    by_row = own.join(across, ["tile", "col"]).groupBy("tile", "row", F.col("to_col").alias("col")).agg(*sums(F.col("z"), F.lit(1.0)))
    met = by_row.join(down, ["tile", "row"]).groupBy("tile", F.col("to_row").alias("row"), "col").agg(*sums(F.col("a"), F.col("b")))
    mean = F.when(F.abs("b") > 1e-9, F.col("a") / F.col("b"))
    z = {"sum": F.col("a"), "rms": F.sqrt(mean)}.get(method, mean)
    grid = sizes.select("tile", F.explode(F.sequence(F.lit(0), F.col("new_rows").cast("int") - 1)).alias("row"), F.col("new_cols").cast("int").alias("k")).select("tile", "row", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("col"))
    return grid.join(met.select("tile", "row", "col", z.alias("z")), ["tile", "row", "col"], "left")


def resample_to(cells: DataFrame, side: float, method: str) -> DataFrame:
    """RA-8: cells (tile, row, col, x, y, z) with square cells of about a side: each tile's extent is kept and has a whole number of them."""
    from scarpline.functions.projections import affine

    size = cells.groupBy("tile").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")).join(affine(cells), "tile")
    count = lambda n, step: F.greatest(F.lit(1), F.round(F.col(n) * F.abs(F.col(step)) / side)).cast("int")
    size = size.withColumns({"new_rows": count("rows", "e"), "new_cols": count("cols", "a")})
    new = resample_cells(cells, size, method).join(size, "tile")
    x = F.col("c") + (F.col("col") + 0.5) * F.col("a") * F.col("cols") / F.col("new_cols")
    y = F.col("f") + (F.col("row") + 0.5) * F.col("e") * F.col("rows") / F.col("new_rows")
    return new.select("tile", "row", "col", x.alias("x"), y.alias("y"), "z")
