"""Column functions: ranges, names, time rounding, coordinates and grid indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(x: Column, low: float | None = None, high: float | None = None, include: bool = True) -> Column:
    """PF-1: whether x lies in a closed or open range; null and NaN never do."""
    if low is not None and high is not None and low > high:
        raise ValueError("low must not exceed high")
    test = F.lit(True)
    if low is not None:
        test = test & ((x >= low) if include else (x > low))
    if high is not None:
        test = test & ((x <= high) if include else (x < high))
    return F.coalesce(test & ~F.isnan(x.cast("double")) & x.isNotNull(), F.lit(False))


def filter_numeric(x: Column, low=None, high=None, include: bool = True, filler=None) -> Column:
    """PF-2: x inside of the range, else the filler."""
    return F.when(in_range(x, low, high, include), x).otherwise(F.lit(filler))


def drop_no_data(x: Column, values: Sequence) -> Column:
    """PF-3: null for each of the listed values."""
    return F.when(~x.isin(list(values)), x) if values else x


def castable(x: Column, kind: str) -> Column:
    """PF-4: whether a string can be read as numeric or datetime."""
    if kind == "numeric":
        return x.try_cast("double").isNotNull()
    if kind == "datetime":
        return x.try_cast("timestamp").isNotNull()
    raise ValueError(kind)


def clean_station_name(s: Column) -> Column:
    """PF-13: characters that paths don't take become one underscore; quotes, spaces and underscores go from the ends."""
    plain = F.regexp_replace(F.regexp_replace(s, r'[<>:"/\\|?*]', "_"), "_+", "_")
    return F.lower(F.btrim(plain, F.lit("' _")))


def replace_values(x: Column, old: Sequence, new: Sequence) -> Column:
    """PF-16: replacements one after another, so that they chain."""
    for a, b in zip(old, new, strict=True):
        x = F.when(x == a, F.lit(b)).otherwise(x)
    return x


def round_minute(ts: Column) -> Column:
    """WN-13: to the nearest minute, halves to the even one."""
    return F.timestamp_seconds(60 * F.bround(F.unix_micros(ts.cast("timestamp")) / 60e6))


def delta_to_string(seconds: Column, pad: bool = False) -> Column:
    """A duration as days, hours, minutes and seconds."""
    form = "%dd-%02dh-%02dm-%02ds" if pad else "%dd-%dh-%dm-%ds"
    s = seconds.cast("long")
    return F.format_string(form, F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def flat_index(row: Column, col: Column, width) -> Column:
    """CO-8: the row-major index of a cell."""
    return (row * width + col).cast("long")


def row_col(index: Column, width: int) -> tuple[Column, Column]:
    """CO-8, backwards."""
    return F.floor(index / width).cast("int"), F.pmod(index, F.lit(width)).cast("int")


def cell_centre(row: Column, col: Column, transform: Sequence[float]) -> tuple[Column, Column]:
    """CO-4: centre coordinates under the affine transform (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    return c + (col + 0.5) * a + (row + 0.5) * b, f + (col + 0.5) * d + (row + 0.5) * e


def utm_epsg(lon: Column, lat: Column) -> Column:
    """CO-2: the WGS 84 UTM code of a place, by zone and hemisphere."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def unit_of_epsg(epsg: Column) -> Column:
    """CO-3: the unit of a known code."""
    return F.when(epsg == 4326, "degree").when(epsg.between(32601, 32660) | epsg.between(32701, 32760), "meter").otherwise("unknown")


#: The WGS 84 ellipsoid and the UTM projection.
AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """CO-1: easting and northing in the UTM zone of a code, by Krueger's series to the third order (within a millimetre)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    zone = F.pmod(epsg, F.lit(100))
    phi, dlon = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + SCALE * radius * east, F.when(epsg >= 32700, FALSE_NORTH).otherwise(0.0) + SCALE * radius * north


def are_geographic(lon: Column, lat: Column) -> Column:
    """PF-8, an aggregate: whether all coordinates can be degrees of longitude and latitude."""
    return F.coalesce(F.every(lon.between(-180, 180) & lat.between(-90, 90)), F.lit(False))


def is_ordered(step: Column) -> Column:
    """PF-9, an aggregate over steps between neighbours: whether they all go one way."""
    return F.coalesce(F.every(F.coalesce(step >= 0, F.lit(True))) | F.every(F.coalesce(step <= 0, F.lit(True))), F.lit(True))
