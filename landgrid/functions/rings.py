"""Column expressions on rings, arrays of ``struct<x, y>`` whose last point is the first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_ring(x0: str, y0: str, x1: str, y1: str) -> Column:
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _pairs(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def ring_area(ring: Column) -> Column:
    return F.abs(_sum(F.transform(_pairs(ring), lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]))) / 2


def ring_perimeter(ring: Column) -> Column:
    side = lambda p: F.sqrt((p["b"]["x"] - p["a"]["x"]) * (p["b"]["x"] - p["a"]["x"]) + (p["b"]["y"] - p["a"]["y"]) * (p["b"]["y"] - p["a"]["y"]))
    return _sum(F.transform(_pairs(ring), side))


def ring_extent(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"w": F.array_min(xs), "s": F.array_min(ys), "e": F.array_max(xs), "n": F.array_max(ys)}


def chaikin(ring: Column) -> Column:
    """One round of corner cutting of a ring: two points on every side, closed again. Rings under 4 points stay."""
    cut = F.flatten(F.transform(_pairs(ring), lambda p: F.array(_between(p, 0.25), _between(p, 0.75))))
    return F.when(F.size(ring) < 4, ring).otherwise(F.concat(cut, F.slice(cut, 1, 1)))


def _between(p: Column, t: float) -> Column:
    return F.struct((p["a"]["x"] + (p["b"]["x"] - p["a"]["x"]) * t).alias("x"), (p["a"]["y"] + (p["b"]["y"] - p["a"]["y"]) * t).alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Crossing-number test; a point on the lower or left side counts as inside."""
    crossing = lambda p: ((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / (p["b"]["y"] - p["a"]["y"]) + p["a"]["x"])
    return F.size(F.filter(_pairs(ring), crossing)) % 2 == 1


KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")
_POSITION = r"\[\s*(-?[0-9][0-9.eE+-]*)\s*,\s*(-?[0-9][0-9.eE+-]*)"


def geometry_extent(geojson: Column) -> Column:
    """``struct(w, s, e, n)`` of a GeoJSON geometry of any of the seven KINDS, collections within collections included.

    Positions are the innermost arrays, at whatever depth; further numbers in them, such as heights, don't count. Null
    for null, for another kind and for a geometry without positions, such as an empty collection.
    """
    pairs = F.regexp_extract_all(geojson, F.lit(_POSITION), F.lit(0))
    axis = lambda i: F.transform(pairs, lambda p: F.regexp_extract(p, _POSITION, i).cast("double"))
    box = F.struct(F.array_min(axis(1)).alias("w"), F.array_min(axis(2)).alias("s"), F.array_max(axis(1)).alias("e"), F.array_max(axis(2)).alias("n"))
    return F.when(F.get_json_object(geojson, "$.type").isin(*KINDS) & (F.size(pairs) > 0), box)
