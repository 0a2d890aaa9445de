"""Plane geometry as columns of structs: point(x, y), box(high, low), lseg(a, b), line(a, b, c), circle(center, radius), and
paths and polygons as arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.base import col

EPS = 1e-6


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def box(a: Column, b: Column) -> Column:
    """From two corners, whichever they are."""
    hi = point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))
    lo = point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]))
    return F.struct(hi.alias("high"), lo.alias("low"))


def lseg(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def circle(center: Column, radius) -> Column:
    return F.struct(center.alias("center"), col(radius).cast("double").alias("radius"))


def line(p: Column, q: Column) -> Column:
    """A x + B y + C = 0 through two points, B being -1 unless the line is upright."""
    m = (q["y"] - p["y"]) / F.nullif(q["x"] - p["x"], F.lit(0.0))
    return F.struct(F.coalesce(m, F.lit(-1.0)).alias("a"), F.when(m.isNull(), 0.0).otherwise(-1.0).alias("b"), F.when(m.isNull(), p["x"]).otherwise(p["y"] - m * p["x"]).alias("c"))


def distance(a: Column, b: Column) -> Column:
    """Between two points, <->."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def slope(a: Column, b: Column) -> Column:
    """Infinite for an upright pair."""
    return F.coalesce((b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)), F.lit(math.inf))


def width(b: Column) -> Column:
    return b["high"]["x"] - b["low"]["x"]


def height(b: Column) -> Column:
    return b["high"]["y"] - b["low"]["y"]


def box_area(b: Column) -> Column:
    return width(b) * height(b)


def circle_area(c: Column) -> Column:
    return c["radius"] * c["radius"] * math.pi


def polygon_area(p: Column) -> Column:
    """By the sum of cross products; also of a closed path."""
    n = F.size(p)
    at = lambda i: F.get(p, i % n)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i)["x"] * at(i + 1)["y"] - at(i)["y"] * at(i + 1)["x"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


path_area = polygon_area


def box_center(b: Column) -> Column:
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def diagonal(b: Column) -> Column:
    return lseg(b["high"], b["low"])


def diameter(c: Column) -> Column:
    return c["radius"] * 2


def radius(c: Column) -> Column:
    return c["radius"]


def bound_box(a: Column, b: Column) -> Column:
    """The smallest box around two."""
    return box(point(F.greatest(a["high"]["x"], b["high"]["x"]), F.greatest(a["high"]["y"], b["high"]["y"])), point(F.least(a["low"]["x"], b["low"]["x"]), F.least(a["low"]["y"], b["low"]["y"])))


def polygon_box(p: Column) -> Column:
    lo = lambda k: F.array_min(F.transform(p, lambda q: q[k]))
    hi = lambda k: F.array_max(F.transform(p, lambda q: q[k]))
    return box(point(hi("x"), hi("y")), point(lo("x"), lo("y")))


def circle_box(c: Column) -> Column:
    """The box inscribed in a circle."""
    d = c["radius"] / math.sqrt(2)
    return box(point(c["center"]["x"] + d, c["center"]["y"] + d), point(c["center"]["x"] - d, c["center"]["y"] - d))


def box_circle(b: Column) -> Column:
    """The circle around a box."""
    return circle(box_center(b), distance(box_center(b), b["high"]))


def box_polygon(b: Column) -> Column:
    x0, y0, x1, y1 = b["low"]["x"], b["low"]["y"], b["high"]["x"], b["high"]["y"]
    return F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0))


def circle_polygon(c: Column, n: int = 12) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(c["center"]["x"] - c["radius"] * F.cos(i * (2 * math.pi / n)), c["center"]["y"] + c["radius"] * F.sin(i * (2 * math.pi / n))))


def polygon_center(p: Column) -> Column:
    mean = lambda k: F.aggregate(p, F.lit(0.0), lambda a, q: a + q[k]) / F.size(p)
    return point(mean("x"), mean("y"))


def npoints(p: Column) -> Column:
    return F.size(p)


def path(points: Column, closed: bool) -> Column:
    return F.struct(points.alias("points"), F.lit(closed).alias("closed"))


def isopen(p: Column) -> Column:
    return ~p["closed"]


def isclosed(p: Column) -> Column:
    return p["closed"]


def popen(p: Column) -> Column:
    return path(p["points"], False)


def pclose(p: Column) -> Column:
    return path(p["points"], True)


def path_length(p: Column) -> Column:
    q = p["points"]
    steps = F.transform(F.sequence(F.lit(1), F.size(q)), lambda i: F.when(i < F.size(q), distance(F.get(q, i - 1), F.get(q, i))).when(p["closed"], distance(F.get(q, i - 1), F.get(q, F.lit(0)))).otherwise(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


# -- operators ----------------------------------------------------------------------------------


def translate(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def multiply(a: Column, b: Column) -> Column:
    """Scaling and turning, as of complex numbers."""
    return point(a["x"] * b["x"] - a["y"] * b["y"], a["x"] * b["y"] + a["y"] * b["x"])


def divide(a: Column, b: Column) -> Column:
    n = b["x"] * b["x"] + b["y"] * b["y"]
    return point((a["x"] * b["x"] + a["y"] * b["y"]) / n, (a["y"] * b["x"] - a["x"] * b["y"]) / n)


def box_contains_point(b: Column, p: Column) -> Column:
    return p["x"].between(b["low"]["x"], b["high"]["x"]) & p["y"].between(b["low"]["y"], b["high"]["y"])


def box_overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def box_contains(a: Column, b: Column) -> Column:
    return box_contains_point(a, b["high"]) & box_contains_point(a, b["low"])


def box_intersection(a: Column, b: Column) -> Column:
    """a # b; null if they have nothing in common."""
    high = point(F.least(a["high"]["x"], b["high"]["x"]), F.least(a["high"]["y"], b["high"]["y"]))
    low = point(F.greatest(a["low"]["x"], b["low"]["x"]), F.greatest(a["low"]["y"], b["low"]["y"]))
    return F.when(box_overlaps(a, b), F.struct(high.alias("high"), low.alias("low")))


def circle_contains_point(c: Column, p: Column) -> Column:
    return distance(c["center"], p) <= c["radius"]


def circle_overlaps(a: Column, b: Column) -> Column:
    return distance(a["center"], b["center"]) <= a["radius"] + b["radius"]


def circle_distance(a: Column, b: Column) -> Column:
    return F.greatest(distance(a["center"], b["center"]) - a["radius"] - b["radius"], F.lit(0.0))


def line_distance(p: Column, li: Column) -> Column:
    return F.abs(li["a"] * p["x"] + li["b"] * p["y"] + li["c"]) / F.hypot(li["a"], li["b"])


def closest_point(p: Column, s: Column) -> Column:
    """p ## s: of a segment."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    t = ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return point(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)


def segment_distance(p: Column, s: Column) -> Column:
    return distance(p, closest_point(p, s))


def segments_meet(s: Column, t: Column) -> Column:
    """s ?# t."""
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    d1, d2, d3, d4 = turn(s["a"], s["b"], t["a"]), turn(s["a"], s["b"], t["b"]), turn(t["a"], t["b"], s["a"]), turn(t["a"], t["b"], s["b"])
    on = (segment_distance(t["a"], s) <= EPS) | (segment_distance(t["b"], s) <= EPS) | (segment_distance(s["a"], t) <= EPS) | (segment_distance(s["b"], t) <= EPS)
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | on


def is_horizontal(s: Column) -> Column:
    return F.abs(s["a"]["y"] - s["b"]["y"]) <= EPS


def is_vertical(s: Column) -> Column:
    return F.abs(s["a"]["x"] - s["b"]["x"]) <= EPS


def is_parallel(s: Column, t: Column) -> Column:
    return F.abs((s["b"]["x"] - s["a"]["x"]) * (t["b"]["y"] - t["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (t["b"]["x"] - t["a"]["x"])) <= EPS


def is_perpendicular(s: Column, t: Column) -> Column:
    return F.abs((s["b"]["x"] - s["a"]["x"]) * (t["b"]["x"] - t["a"]["x"]) + (s["b"]["y"] - s["a"]["y"]) * (t["b"]["y"] - t["a"]["y"])) <= EPS


def polygon_contains_point(p: Column, q: Column) -> Column:
    """Edges count as inside."""
    n = F.size(p)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: lseg(F.get(p, i), F.get(p, (i + 1) % n)))
    crosses = lambda e: ((e["a"]["y"] > q["y"]) != (e["b"]["y"] > q["y"])) & (q["x"] < (e["b"]["x"] - e["a"]["x"]) * (q["y"] - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    inside = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return inside | F.exists(edges, lambda e: segment_distance(q, e) <= EPS)


def left_of(a: Column, b: Column) -> Column:
    """a << b, of boxes."""
    return a["high"]["x"] < b["low"]["x"]


def above(a: Column, b: Column) -> Column:
    """a |>> b, of boxes."""
    return a["low"]["y"] > b["high"]["y"]


def point_text(p: Column) -> Column:
    num = lambda x: F.regexp_replace(F.round(x, 6).cast("string"), r"\.0$", "")
    return F.concat(F.lit("("), num(p["x"]), F.lit(","), num(p["y"]), F.lit(")"))
