"""CO-1, CO-2, CO-7, CO-13, VE-8: coordinates between geographic codes, UTM zones and the web Mercator plane, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.functions.scalars import AXIS, FALSE_EAST, FALSE_NORTH, FLATTENING, SCALE, to_utm, utm_epsg

#: Codes of longitude and latitude, of the web Mercator plane, and of UTM zones on ellipsoids that differ by under a millimetre.
GEOGRAPHIC, WEB_MERCATOR = (4326, 4258), 3857
#: Fixed values: (south, north, west, east, zone) of the zones that are wider or narrower than six degrees.
SPECIAL_ZONES = ((56, 64, 3, 12, 32), (72, 84, 0, 9, 31), (72, 84, 9, 21, 33), (72, 84, 21, 33, 35), (72, 84, 33, 42, 37))


def _utm_code(epsg: Column) -> Column:
    """A UTM code of the European system as that of WGS 84 for the same zone."""
    return F.when(epsg.between(25828, 25838), epsg - 25800 + 32600).otherwise(epsg)


def from_utm(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """CO-1: longitude and latitude of a place in the UTM zone of a code, by Krueger's series backwards (within a millimetre)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    e = 2 * n**0.5 / (1 + n)
    xi = (north - F.when(epsg >= 32700, FALSE_NORTH).otherwise(0.0)) / (SCALE * radius)
    eta = (east - FALSE_EAST) / (SCALE * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    # the conformal latitude's tangent, then the latitude's own by three steps of a fixed point that gains three digits each
    goal = F.atanh(F.sin(x) / F.cosh(y))
    phi = F.asin(F.tanh(goal))
    for _ in range(4):
        phi = F.asin(F.tanh(goal + e * F.atanh(e * F.sin(phi))))
    return F.pmod(F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (F.pmod(epsg, F.lit(100)) * 6 - 183) + 540, F.lit(360.0)) - 180, F.degrees(phi)


def convert(x: Column, y: Column, source: Column, target: Column) -> tuple[Column, Column]:
    """CO-1: coordinates from one code to another, longitude before latitude; null for a code that is not known.

    Known are 4326, 4258, 3857, 326xx, 327xx and 25828-25838.
    """
    known = lambda c: c.isin(*GEOGRAPHIC, WEB_MERCATOR) | c.between(32601, 32660) | c.between(32701, 32760) | c.between(25828, 25838)
    of_utm = from_utm(x, y, _utm_code(source))
    web = F.degrees(x / AXIS), F.degrees(2 * F.atan(F.exp(y / AXIS))) - 90
    lon, lat = (F.when(source.isin(*GEOGRAPHIC), a).when(source == WEB_MERCATOR, b).otherwise(c) for a, b, c in zip((x, y), web, of_utm))
    to = to_utm(lon, lat, _utm_code(target))
    # beyond a pole there is no place on the plane: not a number, as of any other logarithm of a negative number, and not null, which sums would pass over
    rise = F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))
    mercator = F.radians(lon) * AXIS, F.when(rise < 0, F.lit(float("nan"))).otherwise(F.log(rise)) * AXIS
    same = known(source) & known(target)
    return tuple(F.when(same, F.when(source == target, own).when(target.isin(*GEOGRAPHIC), a).when(target == WEB_MERCATOR, b).otherwise(c)) for own, a, b, c in zip((x, y), (lon, lat), mercator, to))


def convert_ring(ring: Column, source: Column, target: Column) -> Column:
    """VE-8: every vertex of a ring from one code to another."""
    def vertex(p):
        x, y = convert(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, vertex)


def special_utm_epsg(lon: Column, lat: Column) -> Column:
    """CO-2 with the wider and narrower zones of Norway and Svalbard."""
    zone = utm_epsg(lon, lat)
    for south, north, west, east, special in SPECIAL_ZONES:
        zone = F.when((lat >= south) & (lat < north) & (lon >= west) & (lon < east), 32600 + special).otherwise(zone)
    return zone.cast("int")


def box_epsg(x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """CO-2: of a box in degrees its first UTM code from the west, and whether it has places of other codes: (epsg, several).

    A box on both sides of the equator takes the side on which more of it lies.
    """
    first = utm_epsg(x_min, y_min + y_max)
    several = (utm_epsg(x_max, y_min + y_max) != first) | ((y_min < 0) & (y_max > 0))
    return F.struct(first.alias("epsg"), several.alias("several"))


def with_projected(df: DataFrame, x: str = "lon", y: str = "lat", target: int | None = None) -> DataFrame:
    """CO-13: adds prj_epsg, prj_x and prj_y, in the one code given or else that of the box around all rows."""
    if target is not None:
        code = df.sparkSession.range(1).select(F.lit(target).alias("prj_epsg"))
    else:
        code = df.agg(box_epsg(F.min(x), F.max(x), F.min(y), F.max(y)).alias("b")).select(F.col("b.epsg").alias("prj_epsg"))
    met = df.join(F.broadcast(code))  # one row
    east, north = convert(F.col(x), F.col(y), F.lit(4326), F.col("prj_epsg"))
    return met.withColumns({"prj_x": east, "prj_y": north})


def convert_cells(cells: DataFrame, source: Column, target: Column) -> DataFrame:
    """CO-7: the centres x and y of cells from one code to another."""
    x, y = convert(F.col("x"), F.col("y"), source, target)
    return cells.withColumns({"_x": x, "_y": y}).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def affine(cells: DataFrame) -> DataFrame:
    """CO-7: the transform (tile, a, c, e, f) of cells (tile, row, col, x, y) on a regular grid: mean spacings along columns (a) and rows (e), and the outer corner of cell (0, 0)."""
    along, down = Window.partitionBy("tile", "row").orderBy("col"), Window.partitionBy("tile", "col").orderBy("row")
    step = cells.withColumns({"_a": (F.lead("x").over(along) - F.col("x")) / (F.lead("col").over(along) - F.col("col")), "_e": (F.lead("y").over(down) - F.col("y")) / (F.lead("row").over(down) - F.col("row"))})
    mean = step.groupBy("tile").agg(F.avg("_a").alias("a"), F.avg("_e").alias("e"), F.min_by(F.struct("x", "y", "row", "col"), F.struct("row", "col")).alias("o"))
    return mean.select("tile", "a", (F.col("o.x") - (F.col("o.col") + 0.5) * F.col("a")).alias("c"), "e", (F.col("o.y") - (F.col("o.row") + 0.5) * F.col("e")).alias("f"))
