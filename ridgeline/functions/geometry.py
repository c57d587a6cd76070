"""Planar and 3-D geometry as column expressions: everything stays in the JVM, no UDF.

A ring is an unclosed array of structs with x and y (and z); a polygon is an array of rings, shell first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(**parts: Column) -> Column:
    """A struct by name; unlike aliases, the names also hold inside lambdas."""
    return F.named_struct(*[x for k, v in parts.items() for x in (F.lit(k), v)])


def point(x, y, z=None) -> Column:
    parts = {k: F.lit(v).cast("double") for k, v in (("x", x), ("y", y), ("z", z)) if v is not None}
    return named(**parts)


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def turned(ring: Column, by: int = 1) -> Column:
    """The ring started ``by`` vertices later: the cyclic neighbour of each vertex."""
    return F.concat(F.slice(ring, by + 1, F.size(ring)), F.slice(ring, 1, by))


def cyclic(ring: Column, f) -> Column:
    """Sum of f(vertex, next vertex) around a ring."""
    return total(F.zip_with(ring, turned(ring), f))


# 3-D vectors ---------------------------------------------------------------------------------------------


def minus(a: Column, b: Column) -> Column:
    return named(**{c: a[c] - b[c] for c in "xyz"})


def cross(a: Column, b: Column) -> Column:
    return named(
        x=a["y"] * b["z"] - a["z"] * b["y"],
        y=a["z"] * b["x"] - a["x"] * b["z"],
        z=a["x"] * b["y"] - a["y"] * b["x"],
    )


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def newell(ring: Column) -> Column:
    """Twice the area vector of a ring."""
    return named(
        x=cyclic(ring, lambda a, b: (a["y"] - b["y"]) * (a["z"] + b["z"])),
        y=cyclic(ring, lambda a, b: (a["z"] - b["z"]) * (a["x"] + b["x"])),
        z=cyclic(ring, lambda a, b: (a["x"] - b["x"]) * (a["y"] + b["y"])),
    )


def upward(normal: Column, least: float = 1e-12) -> Column:
    """Unit vector with z up; null if shorter than ``least``."""
    n = norm(normal)
    sign = F.when(normal["z"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(n > least, named(**{c: sign * normal[c] / n for c in "xyz"}))


def angle_degrees(a: Column, b: Column) -> Column:
    """Angle between unit vectors; the product is held to [-1, 1] first, as acos gives NaN beyond."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b)))))


def pitch_degrees(unit: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), unit["z"]))))


def azimuth_degrees(unit: Column) -> Column:
    """Direction of steepest descent, clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(unit["x"] / unit["z"], unit["y"] / unit["z"])), F.lit(360.0))


def rise_per_12(pitch: Column) -> Column:
    return F.tan(F.radians(pitch)) * 12


def mean_vertex(ring: Column) -> Column:
    return named(**{c: total(ring[c]) / F.size(ring) for c in "xyz"})


def length_3d(a: Column, b: Column) -> Column:
    return norm(minus(b, a))


def length_plan(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


# plane -----------------------------------------------------------------------------------------------------


def signed_area(ring: Column) -> Column:
    """By trapezoids: only differences are multiplied by the place, so small areas far from the origin keep their digits."""
    return cyclic(ring, lambda a, b: (a["x"] + b["x"]) * (b["y"] - a["y"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def area(polygon: Column) -> Column:
    """Shell less holes."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return ring_area(polygon[0]) - total(F.transform(holes, ring_area))


def perimeter(polygon: Column) -> Column:
    """Length of all boundaries, those of holes too."""
    return total(F.transform(polygon, lambda r: cyclic(r, length_plan)))


def centroid(ring: Column) -> Column:
    """Area centroid of a ring."""
    first = ring[0]
    at = F.transform(ring, lambda p: named(x=p["x"] - first["x"], y=p["y"] - first["y"]))
    a = signed_area(at) * 6
    w = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    cx = cyclic(at, lambda p, q: (p["x"] + q["x"]) * w(p, q))
    cy = cyclic(at, lambda p, q: (p["y"] + q["y"]) * w(p, q))
    return named(x=first["x"] + F.try_divide(cx, a), y=first["y"] + F.try_divide(cy, a))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(px - a["x"] - t * dx, py - a["y"] - t * dy)


def boundary_distance(px: Column, py: Column, ring: Column) -> Column:
    return F.array_min(F.zip_with(ring, turned(ring), lambda a, b: segment_distance(px, py, a, b)))


def inside_even_odd(px: Column, py: Column, ring: Column) -> Column:
    """Ray cast; points on the boundary may fall either way (see covers)."""

    def crossing(a: Column, b: Column) -> Column:
        straddles = (a["y"] > py) != (b["y"] > py)
        x = a["x"] + F.coalesce(F.try_divide((py - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"]), F.lit(0.0))
        return F.when(straddles & (px < x), 1.0).otherwise(0.0)

    return F.pmod(cyclic(ring, crossing), F.lit(2.0)) == 1


def covers(px: Column, py: Column, ring: Column, tolerance: float = 1e-9) -> Column:
    """Inside or on the boundary."""
    return inside_even_odd(px, py, ring) | (boundary_distance(px, py, ring) <= tolerance)


def contains(px: Column, py: Column, ring: Column, tolerance: float = 1e-9) -> Column:
    """Strictly inside."""
    return inside_even_odd(px, py, ring) & (boundary_distance(px, py, ring) > tolerance)


def distance_to_polygon(px: Column, py: Column, ring: Column) -> Column:
    """0 inside; "within a round buffer of r" is this distance being at most r."""
    return F.when(covers(px, py, ring), F.lit(0.0)).otherwise(boundary_distance(px, py, ring))


def hausdorff(a: Column, b: Column) -> Column:
    """Discrete on vertices: the farthest vertex of either ring from the other's boundary."""
    far = lambda u, v: F.array_max(F.transform(u, lambda p: boundary_distance(p["x"], p["y"], v)))
    return F.greatest(far(a, b), far(b, a))


def clip_convex(subject: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Ring clipped to a box by half-planes in turn (exact for any simple ring as far as its area goes)."""

    def half(ring: Column, inside, meet) -> Column:
        def step(a: Column, b: Column) -> Column:
            ina, inb = inside(a), inside(b)
            none = F.array().cast("array<struct<x:double,y:double>>")
            return F.when(ina & inb, F.array(b)).when(ina, F.array(meet(a, b))).when(inb, F.array(meet(a, b), b)).otherwise(none)

        return F.flatten(F.zip_with(ring, turned(ring), step))

    def at_x(v):
        return lambda a, b: named(x=F.lit(v).cast("double"), y=a["y"] + (b["y"] - a["y"]) * F.coalesce(F.try_divide(v - a["x"], b["x"] - a["x"]), F.lit(0.0)))

    def at_y(v):
        return lambda a, b: named(x=a["x"] + (b["x"] - a["x"]) * F.coalesce(F.try_divide(v - a["y"], b["y"] - a["y"]), F.lit(0.0)), y=F.lit(v).cast("double"))

    ring = half(subject, lambda p: p["x"] >= x0, at_x(x0))
    ring = half(ring, lambda p: p["x"] <= x1, at_x(x1))
    ring = half(ring, lambda p: p["y"] >= y0, at_y(y0))
    return half(ring, lambda p: p["y"] <= y1, at_y(y1))


def simple_ring(ring: Column) -> Column:
    """At least three vertices, an area, and no two sides that cross (all pairs: for small rings)."""
    orient = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    sides = F.zip_with(ring, turned(ring), lambda a, b: named(a=a, b=b))
    cross_ = lambda s, t: (orient(s["a"], s["b"], t["a"]) * orient(s["a"], s["b"], t["b"]) < 0) & (orient(t["a"], t["b"], s["a"]) * orient(t["a"], t["b"], s["b"]) < 0)
    return (F.size(ring) >= 3) & (ring_area(ring) > 0) & ~F.exists(sides, lambda s: F.exists(sides, lambda t: cross_(s, t)))


def normal_ring(ring: Column) -> Column:
    """Counter-clockwise, started at the least vertex: equal rings drawn differently become equal."""
    ccw = F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)
    first = F.array_position(ccw, F.array_min(ccw)).cast("int")
    return F.concat(F.slice(ccw, first, F.size(ccw)), F.slice(ccw, 1, first - 1))


def edge_parameter(p: Column, a: Column, b: Column, tolerance: float) -> Column:
    """Place (0..1) of p along the 3-D edge a-b if within tolerance of it, else null."""
    d, q = minus(b, a), minus(p, a)
    length2 = dot(d, d)
    t = F.try_divide(dot(q, d), length2)
    slack = F.try_divide(F.lit(tolerance), F.sqrt(length2))
    off = named(**{c: q[c] - t * d[c] for c in "xyz"})
    return F.when((t >= -slack) & (t <= 1 + slack) & (norm(off) <= tolerance), F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def height_on_edge(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Height of the edge's line above (px, py); the mean height if the edge is a point in plan."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, n)
    return F.when(n <= 1e-12, (a["z"] + b["z"]) / 2).otherwise(a["z"] + t * (b["z"] - a["z"]))


def side_height(ring: Column, normal: Column, a: Column, b: Column, probe: float = 1.0) -> Column:
    """How much higher than the edge a-b its facet's plane is one probe inwards; 0 for an upright edge."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = F.hypot(dx, dy)
    turn = F.when(signed_area(ring) >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    mx, my = (a["x"] + b["x"]) / 2 - turn * F.try_divide(dy, n) * probe, (a["y"] + b["y"]) / 2 + turn * F.try_divide(dx, n) * probe
    plane = a["z"] - (normal["x"] * (mx - a["x"]) + normal["y"] * (my - a["y"])) / normal["z"]
    return F.when(n <= 1e-12, F.lit(0.0)).otherwise(plane - height_on_edge(mx, my, a, b))
