"""Concave hulls of points nearly in a line or on a circle: triangulations without holes, and one ring around them."""

import numpy as np
import pytest

from cairnfield.functions import hulls

R = np.random.default_rng(3)
ARC, AROUND = np.linspace(0, 100, 60), R.uniform(0, 6.3, 80)
MADE = {f"{kind} {e}": make(e) for e in (1e-3, 1e-6, 1e-10, 1e-12) for kind, make in {
    "arc": lambda e: np.stack([ARC, e * (ARC - 50) ** 2], 1), "strip": lambda e: np.stack([R.uniform(0, 100, 200), R.uniform(0, 1, 200) * e], 1), "circle": lambda e: np.stack([np.cos(AROUND), np.sin(AROUND) * (1 + e)], 1) + 1e3,
}.items()}
MADE["lattice"] = np.array([[i * 0.1, j * 0.3] for i in range(20) for j in range(20)])


@pytest.mark.parametrize("kind", sorted(MADE))
def test_flat_points(kind):
    pts = np.unique(MADE[kind], axis=0)
    triangles, sides = hulls.delaunay(pts), {}
    for a, b, c in triangles:
        for side in ((a, b), (b, c), (a, c)):
            sides[tuple(sorted(side))] = sides.get(tuple(sorted(side)), 0) + 1
    assert {v for t in triangles for v in t} == set(range(len(pts)))
    assert max(sides.values()) <= 2 and len(pts) - len(sides) + len(triangles) == 1
    ring = hulls.concave(pts, 0.3)
    assert (ring[0] == ring[-1]).all() and len(np.unique(ring, axis=0)) == len(ring) - 1


def test_points_in_a_line_have_no_triangles():
    assert hulls.delaunay(np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [5.0, 5.0]])) == []
    assert len(hulls.delaunay(np.array([[0.0, 0.0], [0.0, 1.0], [0.0, 2.0], [1.0, 0.5]]))) == 2
