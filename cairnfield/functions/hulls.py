"""Hulls, buffers and simplification in numpy, for Arrow-batched group functions. Convex hulls come with groups of any size reduced to corners
before; concave ones need a group's points together: thousands of them, as a triangle search is a vector operation for each point."""

from __future__ import annotations

import heapq
import math
from itertools import pairwise

import numpy as np


def convex(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, closed; fewer than three distinct points give themselves."""
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return pts

    def half(some: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in some:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return np.array([*ring, ring[0]]) if len(ring) > 2 else np.array(ring)


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles of distinct points, which cover their convex hull whole, by insertion from the least x on. Each point is outside of the hull of those before: the triangles whose circle it is in are
    met over the hull's sides that it sees. Signs that rounding leaves open are worked out in integers, so points in a line or on a circle make no hole and no fold."""
    xy = [(float(x), float(y)) for x, y in points]
    parts = [(x.as_integer_ratio(), y.as_integer_ratio()) for x, y in xy]
    unit = max((d for p in parts for _, d in p), default=1)
    whole = [(m * (unit // d), n * (unit // e)) for (m, d), (n, e) in parts]

    def turn(a: int, b: int, c: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = xy[a], xy[b], xy[c]
        left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
        if abs(left - right) > 4e-16 * (abs(left) + abs(right)):
            return left - right
        return _turn(whole[a], whole[b], whole[c])

    def within(a: int, b: int, c: int, p: int) -> bool:
        det, size = _in_circle(xy[a], xy[b], xy[c], xy[p])
        return det > 0 if abs(det) > 2e-15 * size else _in_circle(whole[a], whole[b], whole[c], whole[p])[0] > 0

    order = sorted(range(len(xy)), key=xy.__getitem__)
    line = 2
    while line < len(order) and turn(order[0], order[1], order[line]) == 0:
        line += 1
    if line >= len(order):
        return []
    # third: of the triangle on the left of a side; after, before: along the hull, counter-clockwise
    third: dict[tuple[int, int], int] = {}

    def add(a: int, b: int, c: int) -> None:
        third[a, b], third[b, c], third[c, a] = c, a, b

    first, last = order[:line], order[line]
    if turn(first[0], first[1], last) < 0:
        first.reverse()
    for a, b in pairwise(first):
        add(a, b, last)
    ring = [*first, last]
    after, before = dict(zip(ring, ring[1:] + ring[:1], strict=True)), dict(zip(ring, ring[-1:] + ring[:-1], strict=True))
    for p in order[line + 1 :]:
        low = high = last
        while turn(before[low], low, p) < 0:
            low = before[low]
        while turn(high, after[high], p) < 0:
            high = after[high]
        sides, u = [], low
        while u != high:
            sides.append((u, after[u]))
            u = after[u]
        after[low], before[p], after[p], before[high] = p, low, high, p
        while sides:
            u, v = sides.pop()
            w = third.get((u, v))
            if w is not None and within(u, v, w, p):
                del third[u, v], third[v, w], third[w, u]
                sides += [(u, w), (w, v)]
            else:
                add(v, u, p)
        last = p
    return [(a, b, c) for (a, b), c in third.items() if a < b and a < c]


def _in_circle(a: tuple, b: tuple, c: tuple, p: tuple) -> tuple:
    """A number above zero where p is in the circle through a, b, c (counter-clockwise), and the size of what it is the sum of."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    bxcy, cxby, cxay, axcy, axby, bxay = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    size = (abs(bxcy) + abs(cxby)) * a2 + (abs(cxay) + abs(axcy)) * b2 + (abs(axby) + abs(bxay)) * c2
    return a2 * (bxcy - cxby) + b2 * (cxay - axcy) + c2 * (axby - bxay), size


def _circle(pts: np.ndarray, triangle: tuple[int, int, int]) -> tuple[float, float, float]:
    """Centre and squared radius of the circle through a triangle's corners; endless for corners in a line."""
    (ax, ay), (bx, by), (cx, cy) = pts[triangle[0]], pts[triangle[1]] - pts[triangle[0]], pts[triangle[2]] - pts[triangle[0]]
    d = 2 * (bx * cy - by * cx)
    if d == 0:
        return 0.0, 0.0, math.inf
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    return ux + ax, uy + ay, ux * ux + uy * uy


def concave(points: np.ndarray, ratio: float = 0.45) -> np.ndarray:
    """Concave hull: border edges of the triangulation longer than min + ratio * (max - min) are eroded, longest first, as long as
    the border stays one ring through all its points. Fewer than four points give the convex hull."""
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(pts) < 4:
        return convex(pts)
    triangles = {tuple(sorted(t)) for t in delaunay(pts)}
    if not triangles:
        return convex(pts)
    of: dict[tuple[int, int], set] = {}
    for t in triangles:
        for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
            of.setdefault(e, set()).add(t)
    size = {e: float(np.hypot(*(pts[e[0]] - pts[e[1]]))) for e in of}
    limit = min(size.values()) + ratio * (max(size.values()) - min(size.values()))
    border = {e for e, ts in of.items() if len(ts) == 1}
    on = {v for e in border for v in e}
    # an edge whose triangle has its third corner on the border stays, as that corner does
    open_ = [(-size[e], -e[0], -e[1]) for e in border if size[e] > limit]
    heapq.heapify(open_)
    while open_:
        _, a, b = heapq.heappop(open_)
        e = (-a, -b)
        t = next(iter(of[e]))
        third = next(iter(set(t) - set(e)))
        if third in on:
            continue
        border.discard(e)
        for f in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
            of[f].discard(t)
            if f != e:
                border.add(f)
                if size[f] > limit:
                    heapq.heappush(open_, (-size[f], -f[0], -f[1]))
        on.add(third)
    after: dict[int, list[int]] = {}
    for a, b in border:
        after.setdefault(a, []).append(b)
        after.setdefault(b, []).append(a)
    ring, last = [min(after)], None
    while True:
        step = [v for v in after[ring[-1]] if v != last]
        last = ring[-1]
        ring.append(step[0])
        if ring[-1] == ring[0]:
            break
    out = pts[ring]
    return out if area(out) > 0 else out[::-1]


def buffer(ring: np.ndarray, distance: float, quarter: int = 8) -> np.ndarray:
    """Outline around a point, a segment or a convex ring: the hull of discs at its points, so a concave ring is buffered as its hull."""
    angles = np.arange(4 * quarter) * (math.pi / 2 / quarter)
    disc = np.stack([np.cos(angles), np.sin(angles)], 1) * distance
    return convex((np.asarray(ring)[:, None, :] + disc[None]).reshape(-1, 2))


def offset(ring: np.ndarray, distance: float, quarter: int = 12) -> np.ndarray:
    """Outline at a distance outside of a simple closed counter-clockwise ring, with arcs at its outward corners. Where a notch is too
    narrow for that (the ring would not be inside), the convex outline is given instead."""
    if len(ring) < 4:
        return buffer(ring, distance, quarter)
    out = []
    n = len(ring) - 1
    for i in range(n):
        a, b, c = ring[i - 1 if i else n - 1], ring[i], ring[i + 1]
        first, second = b - a, c - b
        u, v = np.array([first[1], -first[0]]), np.array([second[1], -second[0]])
        t0, t1 = math.atan2(u[1], u[0]), math.atan2(v[1], v[0])
        turn = (t1 - t0) % (2 * math.pi)
        if turn <= math.pi:
            for k in range(steps := max(1, math.ceil(turn / (math.pi / 2 / quarter)))):
                t = t0 + turn * k / steps
                out.append(b + distance * np.array([math.cos(t), math.sin(t)]))
            out.append(b + distance * np.array([math.cos(t1), math.sin(t1)]))
        else:  # an inward corner: where the two shifted edges meet, if they do before their ends
            w = u / np.hypot(*u) + v / np.hypot(*v)
            k = distance * 2 / max(float(w @ w), 1e-9)
            out.append(b + w * min(k, 4 * distance))
    out.append(out[0])
    grown = np.array(out)
    return grown if contains(grown, ring).all() and area(grown) > area(ring) else buffer(convex(ring), distance, quarter)


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker; the ends stay."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, rest = line[b] - line[a], line[a + 1 : b] - line[a]
        size = float(d @ d)
        t = np.clip(rest @ d / size, 0, 1) if size else np.zeros(len(rest))
        away = np.hypot(*(rest - t[:, None] * d).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def contains(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether points are inside a closed ring (even-odd rule)."""
    x, y = points[:, 0, None], points[:, 1, None]
    x0, y0, x1, y1 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return cross.sum(1) % 2 == 1


def footprint(lonlat: np.ndarray, metres: float, shape: str = "convex", ratio: float = 0.45, tolerance: float = 0.0, digits: int | None = None, latitude: float | None = None) -> np.ndarray:
    """Hull of lon/lat points with a margin in metres, worked out in metres around their mean latitude (or the one given)."""
    lat0 = float(np.mean(lonlat[:, 1])) if latitude is None else latitude
    origin = lonlat.mean(0)
    scale = np.array([math.cos(math.radians(lat0)) * 111_320.0, 111_320.0])
    flat = (lonlat - origin) * scale
    ring = convex(flat) if shape == "convex" else concave(flat, ratio)
    grown = buffer(ring, metres) if shape == "convex" else offset(ring, metres)
    if tolerance:
        grown = simplify(grown, tolerance)
    out = grown / scale + origin
    return out if digits is None else np.round(out, digits)
