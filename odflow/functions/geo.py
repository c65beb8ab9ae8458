"""Geographic expressions over columns of degrees, and over shapes.

A shape is an array of closed rings (arrays of points x, y): all outer rings of its
parts run counter-clockwise, all holes clockwise, so areas and centres add up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.01  # fixed value: the sphere's radius


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; the root is clamped so that antipodes do not leave the arc sine's domain."""
    return haversine_of(F.radians(lat1), F.cos(F.radians(lat1)), F.radians(lng1), F.radians(lat2), F.cos(F.radians(lat2)), F.radians(lng2))


def haversine_of(lat1: Column, cos1: Column, lng1: Column, lat2: Column, cos2: Column, lng2: Column) -> Column:
    """The same of radians and the latitudes' cosines."""
    half_lat, half_lng = F.sin((lat1 - lat2) / 2), F.sin((lng1 - lng2) / 2)
    root = F.sqrt(half_lat * half_lat + cos1 * cos2 * half_lng * half_lng)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), root))


def square_ring(x: Column, y: Column, half: float) -> Column:
    """Closed ring of an axis-aligned square around (x, y)."""
    corner = lambda sx, sy: F.struct((x + sx * half).alias("x"), (y + sy * half).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def regular_ring(x: Column, y: Column, radius: float, sides: int) -> Column:
    """Closed ring of a regular polygon."""
    import math

    turn = [2 * math.pi * (k % sides) / sides for k in range(sides + 1)]
    return F.array(*[F.struct((x + radius * math.cos(t)).alias("x"), (y + radius * math.sin(t)).alias("y")) for t in turn])


def _ring_edges(ring: Column) -> Column:
    size = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(size - 1, F.lit(0))), F.slice(ring, 2, F.greatest(size - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _edges(shape: Column) -> Column:
    return F.flatten(F.transform(shape, _ring_edges))


def oriented(ring: Column, outer: Column) -> Column:
    """The ring, turned round if need be: outer ones counter-clockwise, holes clockwise."""
    return F.when((signed_area(F.array(ring)) >= 0) == outer, ring).otherwise(F.reverse(ring))


def _sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e["p"], e["q"]))


def signed_area(shape: Column) -> Column:
    """Shoelace area of the rings, each positive if counter-clockwise."""
    return _sum(_edges(shape), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def polygon_area(shape: Column, mode: str = "planar") -> Column:
    """Area without the holes. planar: units of the coordinates, over 10**6 as metres to square kilometres; sphere: degrees to square kilometres.

    On the sphere edges are straight in degrees, and the sine of the latitude is taken
    to be linear along them: exact along meridians and parallels, else an edge of dx by
    dy radians is off by at most R * R * dx * dy * dy / 12.
    """
    if mode == "planar":
        return F.abs(signed_area(shape)) / 1e6
    if mode != "sphere":
        raise ValueError(f"unknown mode {mode!r}")
    term = lambda p, q: (F.radians(q["x"]) - F.radians(p["x"])) * (2 + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"])))
    return F.abs(_sum(_edges(shape), term)) * EARTH_KM * EARTH_KM / 2


def polygon_centroid(shape: Column) -> Column:
    """Struct x, y: the centre of mass of the area, over all parts and without the holes."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    six = 6 * signed_area(shape)
    x = _sum(_edges(shape), lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / six
    y = _sum(_edges(shape), lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / six
    return F.struct(x.alias("x"), y.alias("y"))


def point_within(x: Column, y: Column, shape: Column) -> Column:
    """Strictly inside, by the even-odd rule over all rings: not in a hole, nor on a boundary."""
    edges = _edges(shape)

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])

    def touches(e: Column) -> Column:
        p, q = e["p"], e["q"]
        on_line = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return on_line & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    inside = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return inside & ~F.exists(edges, touches)


def line_km(points: Column) -> Column:
    """Length of a line of points x, y in degrees, along great circles."""
    return F.aggregate(_ring_edges(points), F.lit(0.0), lambda acc, e: acc + haversine_km(e["p"]["y"], e["p"]["x"], e["q"]["y"], e["q"]["x"]))
