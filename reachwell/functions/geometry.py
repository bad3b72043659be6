"""Planar geometry over rings, arrays of structs (x, y), over polygons, arrays of rings, and over points.

A polygon's outer rings turn to the left and its holes to the right, so what
is summed over its edges counts holes as missing. It may have several outer
rings.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
POLYGON = f"array<{RING}>"


def _edges(ring: Column, f) -> Column:
    """The sum of ``f`` over the edges (p to q) of a ring, closed or not."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, following, f), F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Of the ring's area; null for a ring without any."""
    whole = F.nullif(signed_area(ring), F.lit(0.0))

    def one(c: str) -> Column:
        return _edges(ring, lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"])) / (6 * whole)

    return one("x"), one("y")


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1."""
    xs, ys = (F.transform(ring, lambda p: p[c]) for c in ("x", "y"))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether the ring holds the point, by the crossings of a ray to the right."""
    def crosses(p: Column, q: Column) -> Column:
        above = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"])
        return F.when(above & (x < at), 1.0).otherwise(0.0)

    return F.pmod(_edges(ring, crosses), F.lit(2.0)) == 1


def oriented(parts: Column) -> Column:
    """A polygon of parts, arrays of an outer ring and its holes, whichever way these turn."""
    def turned(ring: Column, left: Column) -> Column:
        return F.when((signed_area(ring) < 0) == left, F.reverse(ring)).otherwise(ring)

    return F.flatten(F.transform(parts, lambda part: F.transform(part, lambda ring, i: turned(ring, i == 0))))


def _rings(polygon: Column, f) -> Column:
    return F.aggregate(F.transform(polygon, f), F.lit(0.0), lambda s, v: s + v)


def polygon_area(polygon: Column) -> Column:
    return _rings(polygon, signed_area)


def polygon_centroid(polygon: Column) -> tuple[Column, Column]:
    """Of the area without the holes; null for a polygon without any area."""
    whole = F.nullif(polygon_area(polygon), F.lit(0.0))

    def one(c: str) -> Column:
        return _rings(polygon, lambda ring: _edges(ring, lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"]))) / (6 * whole)

    return one("x"), one("y")


def polygon_length(polygon: Column) -> Column:
    """Of all its edges."""
    return _rings(polygon, lambda ring: _edges(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def polygon_bounds(polygon: Column) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1."""
    return bounds(F.flatten(polygon))


def polygon_holds(polygon: Column, x: Column, y: Column) -> Column:
    """Whether the polygon holds the point and none of its holes does."""
    return F.pmod(F.aggregate(F.transform(polygon, lambda ring: holds(ring, x, y).cast("int")), F.lit(0), lambda s, v: s + v), F.lit(2)) == 1


def albers(lon: Column, lat: Column, first: float = 29.5, second: float = 45.5, lat0: float = 23.0, lon0: float = -96.0) -> tuple[Column, Column]:
    """Equal-area conic projection of degrees to metres on the GRS 80 ellipsoid."""
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(f * (2 - f))

    def q(s: float) -> float:
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(t: float) -> float:
        return math.cos(t) / math.sqrt(1 - (e * math.sin(t)) ** 2)

    t1, t2, t0 = (math.radians(v) for v in (first, second, lat0))
    n = (m(t1) ** 2 - m(t2) ** 2) / (q(math.sin(t2)) - q(math.sin(t1)))
    c = m(t1) ** 2 + n * q(math.sin(t1))
    rho0 = a * math.sqrt(c - n * q(math.sin(t0))) / n
    s = F.sin(F.radians(lat))
    own = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = a * F.sqrt(c - n * own) / n, n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def _clip(triangle: list, clip: list) -> float:
    """Area of the intersection of two triangles that turn to the left."""
    out = triangle
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        points, out = out, []
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in points]
        for i, (x, y) in enumerate(points):
            j = (i + 1) % len(points)
            if side[i] >= 0:
                out.append((x, y))
            if side[i] * side[j] < 0:
                t = side[i] / (side[i] - side[j])
                out.append((x + t * (points[j][0] - x), y + t * (points[j][1] - y)))
        if len(out) < 3:
            return 0.0
    x, y = np.array(out).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def overlap_area(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Area that two simple rings share: both are signed sums of triangles from their first points."""
    return polygon_overlap([a], [b])


def polygon_overlap(a: list[list[tuple[float, float]]], b: list[list[tuple[float, float]]]) -> float:
    """Area that two polygons share; a hole's triangles count against its outer ring's."""
    def triangles(ring: list) -> list[tuple[float, list]]:
        out = []
        for p, q in zip(ring[1:], ring[2:], strict=False):
            o = ring[0]
            turn = (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
            if turn:
                out.append((math.copysign(1, turn), [o, p, q] if turn > 0 else [o, q, p]))
        return out

    first, second = ([t for ring in p for t in triangles(ring)] for p in (a, b))
    return abs(sum(s * t * _clip(x, y) for s, x in first for t, y in second))


def _crossing_heights(xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """The y at which two of the rising segments cross, taken some pairs at a time."""
    n, found = len(xa), [np.zeros(0)]
    slope = (xb - xa) / (yb - ya)
    step = max(1, at_once // max(n, 1))
    for i in range(0, n, step):
        j = slice(i, i + step)
        low, high = np.maximum(ya[j, None], ya), np.minimum(yb[j, None], yb)
        gap = lambda y: (xa[j, None] + (y - ya[j, None]) * slope[j, None]) - (xa + (y - ya) * slope)  # noqa: B023, E731
        first, last = gap(low), gap(high)
        meet = (low < high) & (first * last < 0)
        found.append((low[meet] + (high - low)[meet] * (first[meet] / (first[meet] - last[meet]))))
    return np.concatenate(found)


def area_within(xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, owner: np.ndarray) -> float:
    """Area inside shape 0 and inside at least one other, of shapes whose rising edges have their ``owner``.

    Slabs are bounded by all ends and crossings, so in a slab the edges keep
    their order, and what lies between two of them is one trapezoid.
    """
    slope = (xb - xa) / (yb - ya)
    heights = np.unique(np.concatenate([ya, yb, _crossing_heights(xa, ya, xb, yb)]))
    total = 0.0
    for low, high in zip(heights[:-1], heights[1:], strict=True):
        middle = (low + high) / 2
        own = np.flatnonzero((ya < middle) & (yb > middle))
        x = xa[own] + (middle - ya[own]) * slope[own]
        own, x = own[order := np.argsort(x, kind="stable")], x[order]
        by = np.argsort(owner[own], kind="stable")
        firsts = np.r_[True, owner[own][by][1:] != owner[own][by][:-1]] if len(by) else np.zeros(0, bool)
        turn = np.empty(len(own), np.int64)
        turn[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(firsts, np.arange(len(by)), 0))
        step = 1 - 2 * (turn % 2)  # the first edge of a shape enters it, the second leaves it
        inside = (np.cumsum(np.where(owner[own] == 0, step, 0)) > 0) & (np.cumsum(np.where(owner[own] != 0, step, 0)) > 0)
        total += float((np.diff(x) * inside[:-1]).sum()) * (high - low)
    return total
