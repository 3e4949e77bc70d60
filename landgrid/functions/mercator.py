"""Column expressions of the Web-Mercator tile scheme."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LAT = 85.05112878
HALF = 20037508.3427892  # half circumference of EPSG:3857
RADIUS = 6378137.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def tile_x(lon: Column | str, z: int) -> Column:
    return F.floor((_c(lon) + 180) / 360 * float(2**z))


def tile_y(lat: Column | str, z: int) -> Column:
    """Row of a latitude, clamped to the projection's; may be -1 or 2**z at the clamp."""
    r = F.radians(F.least(F.greatest(_c(lat), F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * float(2**z))


def tile_lon(x: Column | str, z: int) -> Column:
    """Longitude of a tile's north-west corner."""
    return _c(x) / float(2**z) * 360 - 180


def tile_lat(y: Column | str, z: int) -> Column:
    """Latitude of a tile's north-west corner."""
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * _c(y) / float(2**z)))))


def clamp_tile(t: Column, z: int) -> Column:
    return F.least(F.greatest(t, F.lit(0).cast("long")), F.lit(2**z - 1).cast("long"))


def mercator_x(lon: Column | str) -> Column:
    return F.radians(_c(lon)) * RADIUS


def mercator_y(lat: Column | str) -> Column:
    r = F.radians(F.least(F.greatest(_c(lat), F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return F.log(F.tan(F.lit(3.141592653589793 / 4) + r / 2)) * RADIUS


def ground_resolution(lat: Column | str, z: int | Column) -> Column:
    """Metres per pixel of 256-pixel tiles."""
    return F.cos(F.radians(_c(lat))) * (2 * 3.141592653589793 * RADIUS) / (256 * F.pow(F.lit(2.0), _c(z)))


def quadkey(x: Column, y: Column, z: int) -> Column:
    """Base-4 key of a tile, one digit for each zoom level."""
    digits = F.transform(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), lambda b: (F.pmod(F.floor(x / F.pow(F.lit(2.0), b)), F.lit(2)) + 2 * F.pmod(F.floor(y / F.pow(F.lit(2.0), b)), F.lit(2))).cast("string"))
    return F.array_join(digits, "")
