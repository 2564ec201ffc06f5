"""Delaunay tessellation of the points of each partition, and classification of its simplices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.geometry import adjacency_class, residue_distance, tetra_metrics


_SURE = 1e-14  # some ninety roundings: beyond the error of either determinant relative to its terms' sizes


_WELL = 1e-4  # a determinant above this part of its terms gives a centre with some ten digits at least
_OTHERS = np.array([[j for j in range(4) if j != i] for i in range(4)])


def _det3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Determinants of rows, and the sums of their terms' sizes."""
    x, y = b[..., 1] * c[..., 2], b[..., 2] * c[..., 1]
    u, v = b[..., 2] * c[..., 0], b[..., 0] * c[..., 2]
    p, q = b[..., 0] * c[..., 1], b[..., 1] * c[..., 0]
    size = np.abs(a)
    return (
        a[..., 0] * (x - y) + a[..., 1] * (u - v) + a[..., 2] * (p - q),
        size[..., 0] * (np.abs(x) + np.abs(y)) + size[..., 1] * (np.abs(u) + np.abs(v)) + size[..., 2] * (np.abs(p) + np.abs(q)),
    )


class Exact:
    """Signs of determinants of points, in integers: every coordinate is a whole number of the same power of two."""

    def __init__(self, points: np.ndarray):
        fraction, exponent = np.frexp(points)
        self.least = least = int(exponent[points != 0].min(initial=0)) - 53
        self.p = [tuple(int(f * (1 << 53)) << int(e) - 53 - least for f, e in zip(fs, es)) for fs, es in zip(fraction.tolist(), np.where(points == 0, least + 53, exponent).tolist())]

    def turn(self, a: int, b: int, c: int, d: int) -> int:
        """Positive if the tetrahedron has positive volume in this order."""
        o = self.p[d]
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ([x - y for x, y in zip(self.p[k], o)] for k in (a, b, c))
        return ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)

    def inside(self, cell: list[int], k: int) -> bool:
        """Whether point ``k`` is in the circumsphere of a positive cell.

        Ties are broken as if each point were lifted a little, those with lower numbers
        infinitely more; so cospherical points have one tessellation, without flat cells.
        """
        rel = [[x - y for x, y in zip(self.p[v], self.p[k])] for v in cell]
        lift = [x * x + y * y + z * z for x, y, z in rel]
        det = 0
        for i in range(4):
            (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (rel[j] for j in range(4) if j != i)
            det += (-1) ** (i + 3) * lift[i] * (ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx))
        if det:
            return det > 0
        five = [*cell, k]
        for i in sorted(range(5), key=lambda j: five[j]):
            by = (-1) ** (i + 3) * self.turn(*(v for j, v in enumerate(five) if j != i))
            if by:
                return by > 0
        return False


def _start(exact: Exact, n: int) -> list[int]:
    """Four points that span a tetrahedron, the first in order; empty if all lie in a plane."""
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    side = lambda k: tuple(x - y for x, y in zip(exact.p[k], exact.p[0]))
    b = next((k for k in range(1, n) if any(side(k))), None)
    c = next((k for k in range(1, n) if any(cross(side(b), side(k)))), None) if b else None
    d = next((k for k in range(1, n) if exact.turn(0, b, c, k)), None) if c else None
    return [] if d is None else [0, b, c, d] if exact.turn(0, b, c, d) > 0 else [b, 0, c, d]


def delaunay(points: np.ndarray) -> np.ndarray:
    """Tetrahedra (rows of four ascending indices, in order) of the Delaunay tessellation; points in a plane give none."""
    cells = insertion(points)
    inner = np.sort(cells[(cells < len(points)).all(axis=1)], axis=1)
    return inner[np.lexsort(inner.T[::-1])]


def _spheres(p: np.ndarray, cells: np.ndarray, far: int, largest: float) -> np.ndarray:
    """Centre, a radius within which points are surely inside and one beyond which they are surely outside; not numbers where rounding leaves too few digits."""
    o = p[cells[:, 3]]
    a, b, c = (p[cells[:, k]] - o for k in range(3))
    u, v, w = np.cross(b, c), np.cross(c, a), np.cross(a, b)
    x, y, z = ((e**2).sum(axis=1) for e in (a, b, c))
    det = (a * u).sum(axis=1)
    with np.errstate(all="ignore"):
        rel = (x[:, None] * u + y[:, None] * v + z[:, None] * w) / (2 * det)[:, None]
        r = np.sqrt((rel**2).sum(axis=1))
        r[~(np.abs(det) > _WELL * np.sqrt(x * y * z)) | (cells == far).any(axis=1)] = np.nan
    slack = 1e-9 * r + 1e-14 * largest
    return np.column_stack((rel + o, r - slack, r + slack))


def insertion(points: np.ndarray) -> np.ndarray:
    """Positive cells by incremental insertion (Bowyer 1981, Watson 1981); index ``len(points)`` is infinity.

    Cells keep their spheres, which decide for most of them whether the next point is
    inside.  Other signs come from floating point where an error bound proves them, else from integers,
    so grids, cospherical and far-shifted points are tessellated without gaps or
    overlaps.  The outside is made of cells with a point at infinity; there is no
    bounding tetrahedron that could cut the hull.  Points in a plane give none.
    """
    n, exact = len(points), Exact(points)
    first = _start(exact, n)
    if not first:
        return np.zeros((0, 4), dtype=np.int64)
    far = n
    cells = [first]
    for k in range(4):  # outside each face; infinity is on the other side than the corner
        out = [far if j == k else v for j, v in enumerate(first)]
        x, y = [j for j in range(4) if j != k][:2]
        out[x], out[y] = out[y], out[x]
        cells.append(out)
    cells = np.array(cells)
    p = np.vstack((points, np.zeros(3)))
    largest = float(np.abs(points).max())
    ghost, spheres = (cells == far).any(axis=1), _spheres(p, cells, far, largest)
    for k in range(n):
        if k in first:
            continue
        away = np.sqrt(((spheres[:, :3] - p[k]) ** 2).sum(axis=1))
        hit = away < spheres[:, 3]  # false where a sphere is unknown
        real = np.flatnonzero(~(ghost | hit | (away > spheres[:, 4])))  # those that spheres don't decide
        if len(real):
            r = p[cells[real]] - p[k]
            lift = (r**2).sum(axis=2)
            det, size = np.zeros(len(real)), np.zeros(len(real))
            for i in range(4):
                d, s = _det3(*(r[:, j] for j in range(4) if j != i))
                det += (-1) ** (i + 3) * lift[:, i] * d
                size += lift[:, i] * s
            hit[real] = det > 0
            for at in real[np.abs(det) <= _SURE * size].tolist():
                hit[at] = exact.inside(cells[at].tolist(), k)
        outer = np.flatnonzero(ghost)
        corner = np.argmax(cells[outer] == far, axis=1)
        rows = _OTHERS[corner]
        d, s = _det3(*(p[cells[outer, rows[:, j]]] - p[k] for j in range(3)))
        sign = np.where(corner % 2 == 1, 1, -1)  # of moving the new point to the end
        hit[outer] = sign * d > 0
        for at in outer[np.abs(d) <= _SURE * s].tolist():
            turn = exact.turn(*(k if v == far else v for v in cells[at].tolist()))
            if turn == 0:  # in the face's plane: as the cell behind it
                face = [v for v in cells[at].tolist() if v != far]
                behind = np.flatnonzero(~ghost & (np.isin(cells, face).sum(axis=1) == 3))
                turn = 1 if hit[behind].any() else -1
            hit[at] = turn > 0
        gone = cells[hit]
        faces = np.sort(np.stack([gone[:, _OTHERS[i]] for i in range(4)], axis=1).reshape(-1, 3), axis=1)
        _, where, times = np.unique((faces[:, 0] * (n + 1) + faces[:, 1]) * (n + 1) + faces[:, 2], return_index=True, return_counts=True)
        border = where[times == 1]
        new = gone[border // 4].copy()
        new[np.arange(len(new)), border % 4] = k  # on the same side of the face as the corner that goes
        keep = ~hit
        cells, ghost = np.vstack((cells[keep], new)), np.append(ghost[keep], (new == far).any(axis=1))
        spheres = np.vstack((spheres[keep], _spheres(p, new, far, largest)))
    return cells


def _per_chain(key: str, kind: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").drop_duplicates(["x", "y", "z"])
        names = [f"i{k}" for k in range(1, 5)]
        xyz = pdf[["x", "y", "z"]].to_numpy(dtype=float)
        found = pdf["pos"].to_numpy()[delaunay(xyz)] if len(xyz) > 3 else np.zeros((0, 4), dtype=np.int64)
        if not len(found):
            return pd.DataFrame({key: pd.Series(dtype=pdf[key].dtype), **{c: pd.Series(dtype="int64") for c in names}})
        return pd.DataFrame({key: pdf[key].iloc[0], **{c: found[:, k] for k, c in enumerate(names)}})

    return run


def tessellate(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Tetrahedra (key, i1..i4) of the points (key, pos, x, y, z) of each partition.

    A partition is one chain, whose length bounds a task; the operator ships only
    positions and coordinates.  Fewer than four points, or points in a plane, give none.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(pos).cast("long").alias("pos"), "x", "y", "z")
    return rows.groupBy(key).applyInPandas(_per_chain(key, kind), f"{key} {kind}, i1 long, i2 long, i3 long, i4 long")


def simplex_table(cells: DataFrame, residues: DataFrame, key: str, cutoff: float | None = None, digits: int = 3) -> DataFrame:
    """Join the corners' coordinates, leaf and state and add all simplex columns natively.

    ``residues`` has key, pos, x, y, z, leaf, state.  With a cutoff, simplices whose
    longest edge exceeds it are left out.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("pos")) for k in range(1, 5)]))
    long = cells.select(key, *[f"i{k}" for k in range(1, 5)], corner.alias("c")).select("*", "c.k", "c.pos").drop("c")
    full = long.join(residues, [key, "pos"])
    one = lambda k: F.max(F.when(F.col("k") == k, F.struct("x", "y", "z", "leaf", "state")))
    wide = full.groupBy(key, *[f"i{k}" for k in range(1, 5)]).agg(*[one(k).alias(f"p{k}") for k in range(1, 5)])
    wide = tetra_metrics(wide, [f"p{k}" for k in range(1, 5)], digits)
    leaves = [F.col(f"p{k}.leaf") for k in range(1, 5)]
    out = wide.select(
        key, F.concat(*leaves).alias("simplex"), F.array_join(F.array_sort(F.array(*leaves)), "").alias("sorted_simplex"),
        *[F.col(f"i{k}").alias(f"r{k}") for k in range(1, 5)], residue_distance(F.col("i1"), F.col("i4")).alias("residue_distance"),
        *[f"e{k}" for k in range(1, 7)], "volume", "tetrahedrality", *[F.col(f"p{k}.state").alias(f"ss{k}") for k in range(1, 5)],
        F.array(*leaves).alias("leaves"),
    )
    longest = F.greatest(*[F.col(f"e{k}") for k in range(1, 7)])
    return out if cutoff is None else out.where(longest <= cutoff)


def within_cutoffs(simplices: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Union over strict cutoffs of the simplices whose edges are all shorter; ``cutoff`` tells which. One scan."""
    longest = F.greatest(*[F.col(f"e{k}") for k in range(1, 7)])
    fits = F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: longest < c)
    return simplices.select("*", F.explode(fits).alias("cutoff"))


def classify(simplices: DataFrame, key: str) -> DataFrame:
    """Adjacency class, and positions and states ordered with the leaves, each on its own."""
    r, s, leaves = ([F.col(f"{c}{k}") for k in range(1, 5)] for c in ("r", "ss", "l"))
    df = simplices.withColumns({f"l{k}": F.col("leaves")[k - 1] for k in range(1, 5)})
    by = lambda v: F.array_sort(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in zip(leaves, v)]))
    df = df.withColumns({"_r": by(r), "_s": by(s), "class": adjacency_class(r)})
    return df.select(
        key, "sorted_simplex", *[F.col("_r")[k]["b"].alias(f"r{k + 1}") for k in range(4)], "residue_distance", "volume", "tetrahedrality",
        *[F.col("_s")[k]["b"].alias(f"ss{k + 1}") for k in range(4)], "class",
    )
