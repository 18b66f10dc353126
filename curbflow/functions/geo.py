"""Geometry as Column expressions.

A polygon is its boundary segments, array<struct<x1, y1, x2, y2>>, of all rings together: the even-odd rule then serves
holes and several parts alike. Nothing here leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.7613
SEGMENT = "struct<x1: double, y1: double, x2: double, y2: double>"


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((a2 - a1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    # least() skips nulls, so a missing position must be kept apart
    return F.when(a.isNotNull(), F.lit(2 * EARTH_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def segments(*points: tuple[Column, Column]) -> Column:
    """Segments of the ring through these points, closed."""
    closed = [*points, points[0]]
    return F.array(*[F.struct(a[0].cast("double").alias("x1"), a[1].cast("double").alias("y1"), b[0].cast("double").alias("x2"), b[1].cast("double").alias("y2")) for a, b in zip(closed, closed[1:], strict=False)])


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return segments((min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y))


def diamond(x: Column, y: Column, half_x: Column, half_y: Column) -> Column:
    return segments((x - half_x, y), (x, y - half_y), (x + half_x, y), (x, y + half_y))


def covers(segs: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray from the point crosses the boundary an odd number of times. No division."""

    def crosses(s: Column) -> Column:
        straddles = (s["y1"] > y) != (s["y2"] > y)
        left = (x - s["x1"]) * (s["y2"] - s["y1"]) < (s["x2"] - s["x1"]) * (y - s["y1"])
        return straddles & (left == (s["y2"] > s["y1"]))

    return F.aggregate(segs, F.lit(False), lambda inside, s: inside != crosses(s))


def on_boundary(segs: Column, x: Column, y: Column) -> Column:
    def touches(s: Column) -> Column:
        straight = (x - s["x1"]) * (s["y2"] - s["y1"]) == (s["x2"] - s["x1"]) * (y - s["y1"])
        return straight & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))

    return F.exists(segs, touches)


def within(segs: Column, x: Column, y: Column) -> Column:
    """Strictly inside: points on the boundary are not."""
    return covers(segs, x, y) & ~on_boundary(segs, x, y)


def boundary_distance(segs: Column, x: Column, y: Column) -> Column:
    def apart(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        size = dx * dx + dy * dy
        along = F.coalesce(F.try_divide((x - s["x1"]) * dx + (y - s["y1"]) * dy, size), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
        ex, ey = x - (s["x1"] + t * dx), y - (s["y1"] + t * dy)
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(F.transform(segs, apart))


def distance(segs: Column, x: Column, y: Column) -> Column:
    """0 inside or on the boundary, else the distance to it."""
    return F.when(covers(segs, x, y), F.lit(0.0)).otherwise(boundary_distance(segs, x, y))


def within_distance(segs: Column, x: Column, y: Column, most: float | Column) -> Column:
    return distance(segs, x, y) <= most


def bounds(segs: Column) -> dict[str, Column]:
    """min_x, min_y, max_x, max_y."""
    return {
        "min_x": F.array_min(F.transform(segs, lambda s: F.least(s["x1"], s["x2"]))),
        "min_y": F.array_min(F.transform(segs, lambda s: F.least(s["y1"], s["y2"]))),
        "max_x": F.array_max(F.transform(segs, lambda s: F.greatest(s["x1"], s["x2"]))),
        "max_y": F.array_max(F.transform(segs, lambda s: F.greatest(s["y1"], s["y2"]))),
    }


def centroid(segs: Column) -> tuple[Column, Column]:
    """Area centroid, from the signed areas of the segments seen from the first point (rings must wind consistently)."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    ox, oy = segs[0]["x1"], segs[0]["y1"]

    def add(acc: Column, s: Column) -> Column:
        x1, y1, x2, y2 = s["x1"] - ox, s["y1"] - oy, s["x2"] - ox, s["y2"] - oy
        area = x1 * y2 - x2 * y1
        return F.struct((acc["a"] + area).alias("a"), (acc["x"] + area * (x1 + x2)).alias("x"), (acc["y"] + area * (y1 + y2)).alias("y"))

    total = F.aggregate(segs, start, add)
    return ox + F.try_divide(total["x"], 3 * total["a"]), oy + F.try_divide(total["y"], 3 * total["a"])


def crosses_itself(segs: Column) -> Column:
    """Whether two segments cross at an inner point of both."""

    def side(s: Column, x: Column, y: Column) -> Column:
        return F.signum((s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"]))

    def cross(a: Column, b: Column) -> Column:
        return (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) < 0) & (side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) < 0)

    return F.exists(segs, lambda a: F.exists(segs, lambda b: cross(a, b)))


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (min_x, min_y, max_x, max_y) share a point; touching counts."""
    return ~((a[2] < b[0]) | (a[0] > b[2]) | (a[3] < b[1]) | (a[1] > b[3]))


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _runs(items: Column, ends: Column) -> Column:
    """items cut after each of these places (from 0, the last item's among them)."""
    first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
    return F.transform(ends, lambda end, k: F.slice(items, first(k) + 1, end - first(k) + 1))


def rings(segs: Column) -> Column:
    """The closed rings of a boundary, each an array of segments: a ring ends where the next segment begins elsewhere, or at its own start."""

    def chains(own: Column) -> Column:
        follows = lambda i: (F.get(own, i + 1)["x1"] == F.get(own, i)["x2"]) & (F.get(own, i + 1)["y1"] == F.get(own, i)["y2"])
        return _runs(own, F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: ~F.coalesce(follows(i), F.lit(False))))

    def closed(chain: Column) -> Column:
        home = lambda i: (F.get(chain, i)["x2"] == F.get(chain, F.lit(0))["x1"]) & (F.get(chain, i)["y2"] == F.get(chain, F.lit(0))["y1"])
        ends = F.filter(F.sequence(F.lit(0), F.size(chain) - 1), lambda i: home(i) | (i == F.size(chain) - 1))
        return let(ends, lambda e: _runs(chain, e))

    return F.when(F.size(segs) > 0, F.flatten(F.transform(let(segs, chains), closed))).otherwise(F.slice(F.array(segs), 1, 0))


def polygons(segs: Column) -> Column:
    """Polygons of a boundary as GeoJSON coordinates: an outer ring each, then its holes.

    A ring lies in another if most of its segments' middles do; rings at even depth are outer ones.
    """
    points = lambda ring: let(F.transform(ring, lambda s: F.array(s["x1"], s["y1"])), lambda p: F.concat(p, F.slice(p, 1, 1)))

    def lies_in(ring: Column, other: Column) -> Column:
        hits = F.aggregate(ring, F.lit(0), lambda n, s: n + covers(other, (s["x1"] + s["x2"]) / 2, (s["y1"] + s["y2"]) / 2).cast("int"))
        return 2 * hits > F.size(ring)

    def nested(own: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(own) - 1)
        holders = F.transform(numbers, lambda i: F.filter(numbers, lambda j: (i != j) & lies_in(F.get(own, i), F.get(own, j))))

        def grouped(held: Column) -> Column:
            holes = lambda i: F.filter(numbers, lambda j: (F.size(F.get(held, j)) == F.size(F.get(held, i)) + 1) & F.array_contains(F.get(held, j), i))
            outer = F.filter(numbers, lambda i: F.size(F.get(held, i)) % 2 == 0)
            return F.transform(outer, lambda i: F.concat(F.array(points(F.get(own, i))), F.transform(holes(i), lambda j: points(F.get(own, j)))))

        return let(holders, grouped)

    return let(rings(segs), lambda own: F.when(F.size(own) == 1, F.array(F.transform(own, points))).otherwise(nested(own)))


def geometry_json(segs: Column) -> Column:
    """A boundary as GeoJSON text: a Polygon, or a MultiPolygon if it has several outer rings; null without segments."""

    def text(parts: Column) -> Column:
        one = F.struct(F.lit("Polygon").alias("type"), F.get(parts, F.lit(0)).alias("coordinates"))
        return F.when(F.size(parts) == 1, F.to_json(one)).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))))

    return F.when(F.size(segs) > 0, let(polygons(segs), text)).otherwise(F.lit("null"))


class Lambert:
    """Lambert conformal conic projection with two standard parallels (Snyder 1987), in US survey feet.

    The parameters are those of EPSG:2230.
    """

    A, F_INV = 6378137.0, 298.257222101
    PHI1, PHI2, PHI0, LAM0 = (math.radians(d) for d in (33 + 53 / 60, 32 + 47 / 60, 32 + 10 / 60, -(116 + 15 / 60)))
    EAST, NORTH = 2_000_000.0001016, 500_000.0001016
    FOOT = 1200 / 3937

    E = math.sqrt(2 / F_INV - 1 / F_INV**2)

    @classmethod
    def _m(cls, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (cls.E * math.sin(phi)) ** 2)

    @classmethod
    def _t(cls, phi: float) -> float:
        s = cls.E * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (cls.E / 2)

    @classmethod
    def constants(cls) -> tuple[float, float, float]:
        n = (math.log(cls._m(cls.PHI1)) - math.log(cls._m(cls.PHI2))) / (math.log(cls._t(cls.PHI1)) - math.log(cls._t(cls.PHI2)))
        f = cls._m(cls.PHI1) / (n * cls._t(cls.PHI1) ** n)
        return n, f, cls.A * f * cls._t(cls.PHI0) ** n

    @classmethod
    def to_feet(cls, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, f, rho0 = cls.constants()
        phi = F.radians(lat)
        s = F.sin(phi) * cls.E
        t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(cls.E / 2))
        rho = F.pow(t, F.lit(n)) * (cls.A * f)
        theta = (F.radians(lon) - cls.LAM0) * n
        return (rho * F.sin(theta) + cls.EAST) / cls.FOOT, (F.lit(rho0) - rho * F.cos(theta) + cls.NORTH) / cls.FOOT

    @classmethod
    def to_degrees(cls, x: Column, y: Column) -> tuple[Column, Column]:
        """Inverse; the latitude by six rounds of Snyder's iteration."""
        n, f, rho0 = cls.constants()
        east, north = x * cls.FOOT - cls.EAST, F.lit(rho0) - (y * cls.FOOT - cls.NORTH)
        rho = F.sqrt(east * east + north * north)
        t = F.pow(rho / (cls.A * f), F.lit(1 / n))
        first = F.lit(math.pi / 2) - 2 * F.atan(t)
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), first, lambda p, _: F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - F.sin(p) * cls.E) / (1 + F.sin(p) * cls.E), F.lit(cls.E / 2))))
        return F.degrees(F.atan2(east, north) / n + cls.LAM0), F.degrees(phi)


def project(x: Column, y: Column, source: str | None, target: str) -> tuple[Column, Column]:
    """Coordinates in another reference system; EPSG:4326 and EPSG:2230 are known."""
    if not source:
        raise ValueError("the geometry's coordinate reference system is unknown")
    if source == target:
        return x, y
    if (source, target) == ("EPSG:4326", "EPSG:2230"):
        return Lambert.to_feet(x, y)
    if (source, target) == ("EPSG:2230", "EPSG:4326"):
        return Lambert.to_degrees(x, y)
    raise ValueError(f"no projection from {source} to {target}")
