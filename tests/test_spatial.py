"""Tessellations of degenerate points: exact volumes, empty spheres, one result for every order of arithmetic."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainloom.operators import spatial


def exact(points):
    return [[Fraction(x) for x in p] for p in points.tolist()]


def det3(a, b, c):
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def volume(p, cell):
    o = p[cell[3]]
    return abs(det3(*[[x - y for x, y in zip(p[k], o)] for k in cell[:3]]))


def hull_volume(p):
    """Six times the volume of the hull, from all faces that have every point on one side, each plane once."""
    n = len(p)
    centre = [sum(c) / n for c in zip(*p)]
    planes = {}
    for i, j, k in combinations(range(n), 3):
        u, v = ([x - y for x, y in zip(p[m], p[i])] for m in (j, k))
        normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        if not any(normal):
            continue
        sides = [sum(a * (x - y) for a, x, y in zip(normal, q, p[i])) for q in p]
        if all(s <= 0 for s in sides) or all(s >= 0 for s in sides):
            planes[frozenset(m for m, s in enumerate(sides) if s == 0)] = normal
    total = Fraction(0)
    for on, normal in planes.items():
        on, axis = sorted(on), max(range(3), key=lambda a: abs(normal[a]))
        flat = sorted((*[c for a, c in enumerate(p[m]) if a != axis], m) for m in on)
        ring = []
        for pts in (flat, flat[::-1]):  # the hull of the face, by monotone chains
            chain = []
            for q in pts:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]):
                    chain.pop()
                chain.append(q)
            ring += chain[:-1]
        for b, c in zip(ring[1:], ring[2:]):
            total += abs(det3(*[[x - y for x, y in zip(p[m[2]], centre)] for m in (ring[0], b, c)]))
    return total


def inside(p, cell, k):
    rel = [[x - y for x, y in zip(p[v], p[k])] for v in cell]
    lift = [sum(x * x for x in r) for r in rel]
    det = sum((-1) ** (i + 3) * lift[i] * det3(*[r for j, r in enumerate(rel) if j != i]) for i in range(4))
    o = p[cell[3]]
    return det * (1 if det3(*[[x - y for x, y in zip(p[v], o)] for v in cell[:3]]) > 0 else -1) > 0


def check(points, spheres=True):
    cells, p = spatial.delaunay(points), exact(points)
    volumes = [volume(p, c) for c in cells.tolist()]
    assert all(v > 0 for v in volumes)
    if spheres:
        assert not any(inside(p, c, k) for c in cells.tolist() for k in range(len(p)))
    return cells, sum(volumes)


def grid(n, step=1.0):
    return np.array([[x, y, z] for x in range(n) for y in range(n) for z in range(n)], dtype=float) * step


@pytest.mark.parametrize("points, cube", [(grid(3), 8), (grid(4, 0.1), None), (grid(3)[np.random.default_rng(0).permutation(27)], 8), (grid(3) * 1e-30, None), (grid(3) + 2.0**40, 8)])
def test_grids(points, cube):
    cells, total = check(points)
    assert total == hull_volume(exact(points)) if len(points) < 40 else float(total) == pytest.approx(6 * 0.3**3)
    if cube:
        assert total == 6 * cube


def test_rounded_points_shifted_far():
    """Points on a grid of a tenth in the unit cube, shifted by a thousand: no overlaps."""
    rng = np.random.default_rng(1)
    points = np.unique(np.vstack((rng.integers(0, 11, (270, 3)), [[x, y, z] for x in (0, 10) for y in (0, 10) for z in (0, 10)])) / 10, axis=0)
    for shifted in (points, points + 1000):
        cells, total = check(shifted, spheres=False)
        assert float(total) / 6 == pytest.approx(1.0, abs=1e-9) and set(cells.ravel()) == set(range(len(points)))


def test_one_sphere():
    """Points of a sphere with many cospherical ones, and its centre."""
    points = np.array([p for p in np.ndindex(7, 7, 7) if sum((c - 3) ** 2 for c in p) == 9] + [(3, 3, 3)], dtype=float)
    cells, total = check(points)
    assert total == hull_volume(exact(points))


@given(st.lists(st.tuples(*[st.integers(0, 3)] * 3), min_size=4, max_size=14, unique=True))
@settings(max_examples=150, deadline=None)
def test_small_integer_points(points):
    points = np.array(points, dtype=float)
    cells, total = check(points)
    assert total == hull_volume(exact(points))
    if len(cells):
        assert set(cells.ravel()) == set(range(len(points)))
    else:
        assert np.linalg.matrix_rank(points - points[0]) < 3


def test_planes_and_lines_give_none():
    assert len(spatial.delaunay(np.array([[x, y, 0.1] for x in range(4) for y in range(4)], dtype=float))) == 0
    assert len(spatial.delaunay(np.array([[x, x, x] for x in range(9)], dtype=float))) == 0
