"""Geometry as Columns.

A geometry is struct<type string, parts array<array<struct<x double, y double>>>, ring_of array<int>>: coordinate
sequences in lng, lat order; for polygons they are rings, and ring_of says which polygon of a multi-polygon a ring belongs to.
Distances come in three kinds, as the operators ask for: planar degrees, haversine metres or miles, and UTM metres.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
GEOMETRY = f"struct<type:string,parts:array<{LINE}>,ring_of:array<int>>"

EARTH_MILES, EARTH_METRES, MILE_METRES, FOOT_PER_METRE = 3958.7613, 6371008.8, 1609.344, 3.280839895


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str, *lines: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.array(*lines).alias("parts"), F.transform(F.array(*lines), lambda _: F.lit(0)).alias("ring_of"))


# Points.


def haversine(x1: Column, y1: Column, x2: Column, y2: Column, radius: float = EARTH_MILES) -> Column:
    p1, p2 = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(x2 - x1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return haversine(x1, y1, x2, y2, EARTH_METRES)


def azimuth(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Initial bearing in degrees, 0 north, clockwise."""
    p1, p2, d = F.radians(y1), F.radians(y2), F.radians(x2 - x1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))), F.lit(360.0))


def planar2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared planar distance, in squared degrees."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def utm(lon: Column, lat: Column, meridian: float = -87.0) -> Column:
    """Transverse Mercator metres of WGS 84 by Krueger's series to the third order; zone 16 north by default."""
    steps = _utm_steps(meridian)
    return steps[2](steps[1](steps[0](point(lon, lat))))


def utm_line(line: Column, meridian: float = -87.0) -> Column:
    """The line in metres of utm(). A step is a pass over the points, so that what the next one uses more than once is worked out once."""
    return reduce(F.transform, _utm_steps(meridian), line)


def _utm_steps(meridian: float) -> list[Callable[[Column], Column]]:
    """What utm() does from a point in degrees to one in metres, in steps from struct to struct."""
    f, a, k0 = 1 / 298.257223563, 6378137.0, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)

    def conformal(p: Column) -> Column:
        s = F.sin(F.radians(p["y"]))
        return F.struct(F.sinh(F.atanh(s) - e * F.atanh(e * s)).alias("t"), F.radians(p["x"] - meridian).alias("d"))

    def spherical(p: Column) -> Column:
        t, d = p["t"], p["d"]
        return F.struct(F.atan2(t, F.cos(d)).alias("xi"), F.atanh(F.sin(d) / F.sqrt(1 + t * t)).alias("eta"))

    def metric(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        x = eta + sum(((a_j * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta)) for j, a_j in enumerate(alpha)), F.lit(0.0))
        y = xi + sum(((a_j * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta)) for j, a_j in enumerate(alpha)), F.lit(0.0))
        return F.struct((500000.0 + k0 * radius * x).alias("x"), (k0 * radius * y).alias("y"))

    return [conformal, spherical, metric]


# Lines: arrays of points.


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once: higher-order functions evaluate an expression wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def start(line: Column) -> Column:
    return F.get(line, F.lit(0))


def end(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)


def segments(line: Column) -> Column:
    """array<struct<a, b>> of consecutive points."""
    return let(line, lambda l: F.transform(F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))), lambda p, i: F.struct(F.get(l, i).alias("a"), p.alias("b"))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def length(line: Column) -> Column:
    """Haversine metres."""
    return total(F.transform(segments(line), lambda s: metres(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def planar_length(line: Column) -> Column:
    return total(F.transform(segments(line), lambda s: F.sqrt(planar2(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))))


def on_segment(a: Column, b: Column, x: Column, y: Column) -> Column:
    """struct<d2, x, y>: the planar closest point of a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / size))).otherwise(0.0)
    px, py = a["x"] + t * dx, a["y"] + t * dy
    return F.struct(planar2(px, py, x, y).alias("d2"), px.alias("x"), py.alias("y"))


def closest_on(line: Column, x: Column, y: Column) -> Column:
    """struct<d2, x, y>: the planar closest point of a line, the first of several; of one point, that."""
    some = F.when(F.size(line) == 1, F.array(F.struct(line[0].alias("a"), line[0].alias("b")))).otherwise(segments(line))
    return F.array_min(F.transform(some, lambda s: on_segment(s["a"], s["b"], x, y)))


def shoelace(ring: Column) -> Column:
    """Area of a ring in its own units, whatever its direction."""
    return F.abs(total(F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))) / 2


def compactness(ring: Column) -> Column:
    """4 pi area / perimeter squared, 0 without a perimeter."""
    perimeter = planar_length(ring)
    return F.when(perimeter > 0, 4 * math.pi * shoelace(ring) / (perimeter * perimeter)).otherwise(0.0)


def within_miles(line: Column, x: float, y: float, miles: float) -> Column:
    """Whether any vertex is that near."""
    return F.exists(line, lambda p: haversine(p["x"], p["y"], F.lit(x), F.lit(y)) <= miles)


def translate(line: Column, dx: float, dy: float) -> Column:
    return F.transform(line, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rounded(line: Column, digits: int) -> Column:
    return F.transform(line, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))


def densify(line: Column, step: float) -> Column:
    """Points every `step` metres along a line given in metres, its end last; a line of no length is its start."""

    def along(s: Column) -> Column:
        whole = F.element_at(s["upto"], -1)
        marks = F.array_append(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(whole / step) - 1, F.lit(0)).cast("int")), lambda k: k * F.lit(step)), whole)

        def at(d: Column) -> Column:
            k = F.least(F.greatest(F.size(F.filter(s["upto"], lambda u: u <= d)) - 1, F.lit(0)), F.size(s["segs"]) - 1)
            return let(F.struct(F.get(s["segs"], k).alias("s"), F.get(s["upto"], k).alias("lo"), F.get(s["upto"], k + 1).alias("hi")), lambda e: on(e, d))

        def on(e: Column, d: Column) -> Column:
            t = F.when(e["hi"] > e["lo"], (d - e["lo"]) / (e["hi"] - e["lo"])).otherwise(0.0)
            a, b = e["s"]["a"], e["s"]["b"]
            return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

        return F.when(whole == 0, F.slice(line, 1, 1)).otherwise(F.transform(marks, at))

    segs = segments(line)
    upto = F.aggregate(segs, F.array(F.lit(0.0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + F.sqrt(planar2(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))))
    return F.when(F.size(line) < 2, line).otherwise(let(F.struct(segs.alias("segs"), upto.alias("upto")), along))


# Geometries.


def bounds(g: Column) -> Column:
    xs, ys = F.transform(F.flatten(g["parts"]), lambda p: p["x"]), F.transform(F.flatten(g["parts"]), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def _ring_centroid(ring: Column) -> Column:
    """struct<w, x, y> with signed area as weight; about the ring's first point, for precision."""
    o = ring[0]
    cross = lambda s: (s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"]) - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"])
    w = total(F.transform(segments(ring), cross))
    x = total(F.transform(segments(ring), lambda s: (s["a"]["x"] + s["b"]["x"] - 2 * o["x"]) * cross(s)))
    y = total(F.transform(segments(ring), lambda s: (s["a"]["y"] + s["b"]["y"] - 2 * o["y"]) * cross(s)))
    return F.struct(w.alias("w"), (x + 3 * w * o["x"]).alias("x"), (y + 3 * w * o["y"]).alias("y"))


def centroid(g: Column) -> Column:
    """Of areas, else of lengths, else of points."""
    points = F.flatten(g["parts"])
    mean = F.struct((total(F.transform(points, lambda p: p["x"])) / F.size(points)).alias("x"), (total(F.transform(points, lambda p: p["y"])) / F.size(points)).alias("y"))
    segs = F.flatten(F.transform(g["parts"], segments))
    size = lambda s: F.sqrt(planar2(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    long = total(F.transform(segs, size))
    line = F.struct((total(F.transform(segs, lambda s: (s["a"]["x"] + s["b"]["x"]) / 2 * size(s))) / long).alias("x"), (total(F.transform(segs, lambda s: (s["a"]["y"] + s["b"]["y"]) / 2 * size(s))) / long).alias("y"))
    rings = F.transform(g["parts"], lambda r, i: F.struct(_ring_centroid(r).alias("c"), ((i == 0) | (F.get(g["ring_of"], i) != F.get(g["ring_of"], i - 1))).alias("outer")))
    # outer rings add their area, inner ones take theirs away, whichever way they run
    signed = F.transform(rings, lambda r: F.struct(*[(F.when(r["outer"] == (r["c"]["w"] > 0), r["c"][k]).otherwise(-r["c"][k])).alias(k) for k in ("w", "x", "y")]))
    w = total(F.transform(signed, lambda r: r["w"]))
    area = F.struct((total(F.transform(signed, lambda r: r["x"])) / (3 * w)).alias("x"), (total(F.transform(signed, lambda r: r["y"])) / (3 * w)).alias("y"))
    return F.when(g["type"].endswith("Polygon") & (w != 0), area).when(~g["type"].endswith("Point") & (long > 0), line).otherwise(mean)
