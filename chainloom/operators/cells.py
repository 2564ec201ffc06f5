"""Delaunay tessellation of point sets that are too large for a task.

Points are cut into blocks of about equal numbers by slabs, columns and pieces.  A block
tessellates its own points and those around it, and asks the other blocks, through the
boxes of slabs, columns and blocks, for points in the spheres of the cells at its own
points, and beyond the hull faces there.  Blocks that get an answer tessellate again.
Once nothing is in any sphere, the cells at a block's own points are those of the whole
set: signs are exact, and ties are broken by positions, which all blocks share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from math import ldexp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators.ranges import ranked, stored
from chainloom.operators.spatial import _WELL, Exact, insertion

SIZE = 400
_AXES = "xyz"
_PATH = ["slab", "column", "block"]
_TASKS = 4096
_AROUND = 64  # a block whose surroundings touch more blocks than this starts without them and gets points by asking alone


def _tile(df: DataFrame, within: list[str], axis: str, name: str) -> DataFrame:
    """Cut each group along an axis into ``tiles`` pieces of equal numbers."""
    rows = ranked(df, [*within, axis, "pos"])
    sizes = rows.groupBy(*within).agg(F.min("_rank").alias("_least"), F.count(F.lit(1)).alias("_n"))
    place = (F.col("_rank") - F.col("_least")) * F.col("tiles")
    return rows.join(sizes, within).withColumn(name, F.floor(place / F.col("_n"))).drop("_rank", "_least", "_n")


def _frame(points: DataFrame, key: str) -> DataFrame:
    """Four points of each chain that span a tetrahedron; chains in a plane have none and are left out.

    Each next point is the farthest from the point, line or plane so far.
    """
    here = F.struct("pos", "x", "y", "z")
    found = points.groupBy(key).agg(F.min_by(here, "pos").alias("a"))
    minus = lambda u, v: [u(c) - v(c) for c in _AXES]
    at = lambda name: (lambda c: F.col(f"{name}.{c}"))
    p = minus(F.col, at("a"))
    square = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    b, c = minus(at("b"), at("a")), minus(at("c"), at("a"))
    size = [square(p), square(cross(b, p)), F.abs(sum(x * y for x, y in zip(cross(b, c), p)))]
    for name, by in zip("bcd", size):
        so_far = [F.first(n).alias(n) for n in found.columns if n != key]
        found = points.join(found, key).groupBy(key).agg(*so_far, F.max_by(here, by).alias(name))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [Exact(np.array(xyz, dtype=float)).turn(0, 1, 2, 3) != 0 for xyz in zip(*([[r[c] for c in _AXES] for r in pdf[n]] for n in "abcd"))]
            yield pdf[np.array(keep, dtype=bool)]

    return stored(found.select(key, "a", "b", "c", "d").mapInPandas(spans, found.select(key, "a", "b", "c", "d").schema))


def _sphere(exact: Exact, cell: list[int]) -> tuple[float, float, float, float]:
    """Centre and radius from integers."""
    o = exact.p[cell[3]]
    rows = [[x - y for x, y in zip(exact.p[k], o)] for k in cell[:3]]
    lift = [sum(x * x for x in r) for r in rows]
    a, b, c = rows
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    det = 2 * sum(x * y for x, y in zip(a, cross(b, c)))
    rel = [Fraction(lift[0] * x + lift[1] * y + lift[2] * z, det) for x, y, z in zip(cross(b, c), cross(c, a), cross(a, b))]
    return *(ldexp(float(x + y), exact.least) for x, y in zip(rel, o)), ldexp(sqrt(sum(x * x for x in rel)), exact.least)


def _star(key: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The cells at a block's own points: corners in positive order, sphere or half-space, and whether its surroundings certify it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        xyz, pos, own = pdf[list(_AXES)].to_numpy(dtype=float), pdf["pos"].to_numpy(), pdf["own"].to_numpy(dtype=bool)
        cells, far, exact = insertion(xyz), len(pdf), Exact(xyz)
        cells = cells[np.append(own, False)[cells].any(axis=1)]
        ghost = (cells == far).any(axis=1)
        real, outer = cells[~ghost], cells[ghost]
        largest = float(np.abs(xyz).max())
        o = xyz[real[:, 3]]
        a, b, c = (xyz[real[:, k]] - o for k in range(3))
        u, v, w = np.cross(b, c), np.cross(c, a), np.cross(a, b)
        det = (a * u).sum(axis=1)
        with np.errstate(all="ignore"):
            rel = ((a**2).sum(axis=1)[:, None] * u + (b**2).sum(axis=1)[:, None] * v + (c**2).sum(axis=1)[:, None] * w) / (2 * det)[:, None]
            centre, radius = rel + o, np.sqrt((rel**2).sum(axis=1))
            bad = ~(np.abs(det) > _WELL * np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1) * (c**2).sum(axis=1)))
        for at in np.flatnonzero(bad).tolist():
            *centre[at], radius[at] = _sphere(exact, real[at].tolist())
        slack = 1e-9 * radius + 1e-14 * largest
        lo, hi = (pdf[[f"{side}_{c}" for c in _AXES]].to_numpy(dtype=float)[0] for side in ("from", "to"))
        reach = (radius + slack)[:, None]
        sure = ((centre - reach >= lo) & (centre + reach <= hi)).all(axis=1)
        faces, normals, middles = [], [], []
        for cell in outer.tolist():
            k = cell.index(far)
            face = [v for v in cell if v != far]
            if k % 2 == 0:
                face[:2] = face[1::-1]
            q = [exact.p[v] for v in face]
            s, t = ([x - y for x, y in zip(q[k], q[0])] for k in (2, 1))
            n = (s[1] * t[2] - s[2] * t[1], s[2] * t[0] - s[0] * t[2], s[0] * t[1] - s[1] * t[0])
            most = max(abs(x) for x in n)
            faces.append(face)
            normals.append([float(Fraction(x, most)) for x in n])
            middles.append(xyz[face].mean(axis=0))
        faces = np.array(faces, dtype=np.int64).reshape(-1, 3)
        normals, middles = np.array(normals).reshape(-1, 3), np.array(middles).reshape(-1, 3)
        whole = float(pdf["extent"].iloc[0]) + largest
        corners = np.vstack((real, np.column_stack((faces, np.full(len(faces), -1)))))
        offset = (normals * xyz[faces[:, 0]]).sum(axis=1) if len(faces) else np.zeros(0)
        return pd.DataFrame({
            key: pdf[key].iloc[0], "block": pdf["block"].iloc[0], "ghost": np.arange(len(corners)) >= len(real), "certified": np.append(sure, np.zeros(len(faces), dtype=bool)),
            "first": np.append(own[real.min(axis=1)], np.zeros(len(faces), dtype=bool)),
            **{f"i{k + 1}": np.where(corners[:, k] < 0, -1, pos[corners[:, k]]) for k in range(4)},
            "at": list(xyz[np.maximum(corners, 0)].reshape(len(corners), 12)),
            **{f"c{c}": np.append(centre[:, k], middles[:, k]) for k, c in enumerate(_AXES)}, "r": np.append(radius, offset),
            **{f"n{c}": np.append(np.zeros(len(real)), normals[:, k]) for k, c in enumerate(_AXES)}, "slack": np.append(slack, np.full(len(faces), 1e-13 * whole)),
        })

    return run


def _total(terms: Iterator[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _meets() -> Column:
    """Whether a sphere or half-space meets the box low_*, high_*."""
    gap = lambda c: F.greatest(F.col(f"low_{c}") - F.col(f"c{c}"), F.col(f"c{c}") - F.col(f"high_{c}"), F.lit(0.0))
    near = F.sqrt(_total(gap(c) * gap(c) for c in _AXES)) <= F.col("r") + F.col("slack")
    beyond = _total(F.greatest(F.col(f"n{c}") * F.col(f"low_{c}"), F.col(f"n{c}") * F.col(f"high_{c}")) for c in _AXES) - F.col("r") >= -F.col("slack")
    return F.when(F.col("ghost"), beyond).otherwise(near)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose point is exactly in the sphere, or strictly beyond the face."""
    for pdf in batches:
        keep = []
        for ghost, at, x, y, z, *pos in zip(*(pdf[c] for c in ("ghost", "at", "x", "y", "z", "i1", "i2", "i3", "i4", "pos"))):
            n = 3 if ghost else 4
            five = [*zip(pos[:n], np.asarray(at).reshape(4, 3)[:n].tolist()), (pos[4], [x, y, z])]
            order = sorted(range(n + 1), key=lambda k: five[k][0])
            exact = Exact(np.array([five[k][1] for k in order], dtype=float))
            *cell, k = (order.index(j) for j in range(n + 1))
            keep.append(exact.turn(*cell, k) > 0 if ghost else exact.inside(cell, k))
        yield pdf[np.array(keep, dtype=bool)]


def _found(asked: DataFrame, points: DataFrame, levels: list[DataFrame], key: str) -> DataFrame:
    """For each cell that holds points of the whole set, one of them: the next one to its centre or face."""
    asked = asked.withColumnRenamed("block", "home")
    down = asked
    for depth, boxes in enumerate(levels):
        down = down.join(boxes, [key, *_PATH[:depth]]).where(_meets()).drop(*[f"{s}_{c}" for s in ("low", "high") for c in _AXES])
    near = down.join(points.select(key, *_PATH, "pos", *_AXES), [key, *_PATH])
    distance = F.sqrt(_total((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in _AXES))
    beyond = _total(F.col(f"n{c}") * F.col(c) for c in _AXES) - F.col("r")
    depth = F.when(F.col("ghost"), beyond).otherwise(F.col("r") - distance)
    near = near.withColumns({"depth": depth, "distance": distance}).where((F.col("depth") >= -F.col("slack")) & ~F.col("pos").isin(*[F.col(f"i{k}") for k in range(1, 5)]))
    cols = [key, "home", "ghost", "at", "i1", "i2", "i3", "i4", "pos", *_AXES, "distance"]
    certain = near.where(F.col("depth") > F.col("slack")).select(*cols)
    doubtful = near.where(F.col("depth") <= F.col("slack")).select(*cols)
    hits = certain.unionByName(doubtful.mapInPandas(_confirm, doubtful.schema))
    best = hits.groupBy(key, "home", "ghost", "i1", "i2", "i3", "i4").agg(F.min_by(F.struct("pos", *_AXES), F.struct("distance", "pos")).alias("p"))
    return best.select(key, F.col("home").alias("block"), "p.*").distinct()


def tessellate_large(df: DataFrame, key: str, pos: str = "pos", size: int = SIZE) -> DataFrame:
    """Tetrahedra (key, i1..i4) of the points (key, pos, x, y, z) of each chain, in blocks of about ``size`` points.

    The rows are those of ``tessellate``.  ``pos`` is unique in a chain; rows with a null
    or non-finite coordinate are left out, of rows at one place that with the least
    ``pos`` counts.  Fewer than four points, or points in a plane, give none.  A task
    holds a block, the points around it, of at most 64 blocks, and those that share a
    cell with its points.
    """
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < float("inf") for c in _AXES])
    rows = df.where(finite).select(key, F.col(pos).cast("long").alias("pos"), *[F.col(c).cast("double").alias(c) for c in _AXES])
    rows = stored(rows.groupBy(key, *_AXES).agg(F.min("pos").alias("pos")))
    frame = _frame(rows, key)
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.greatest(*[F.max(c) - F.min(c) for c in _AXES]).alias("extent"), *[f(c).alias(f"{n}_{c}") for c in _AXES for n, f in (("all_low", F.min), ("all_high", F.max))])
    each = stored(each.join(frame.select(key), key, "left_semi"))
    points = rows.join(each.select(key, F.ceil(F.cbrt(F.col("_n") / size)).alias("tiles")), key)
    points = _tile(points, [key], "x", "slab")
    points = _tile(points, [key, "slab"], "y", "column")
    points = _tile(points, [key, "slab", "column"], "z", "piece")
    points = stored(points.withColumn("block", (F.col("slab") * F.col("tiles") + F.col("column")) * F.col("tiles") + F.col("piece")).drop("piece", "tiles"))

    box = [f(c).alias(f"{n}_{c}") for c in _AXES for n, f in (("low", F.min), ("high", F.max))]
    leaf = stored(points.groupBy(key, *_PATH).agg(*box, F.count(F.lit(1)).alias("n")))
    over = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in _AXES for n, f in (("low", F.min), ("high", F.max))]
    levels = [stored(leaf.groupBy(key, *_PATH[:k]).agg(*over)) for k in (1, 2)] + [leaf.drop("n")]

    margin = 1.5 * F.cbrt(reduce(lambda a, b: a * b, [F.col(f"high_{c}") - F.col(f"low_{c}") for c in _AXES]) / F.col("n"))
    around = leaf.join(each, key).select(
        key, "block", "extent",
        *[F.when(F.col(f"low_{c}") - margin > F.col(f"all_low_{c}"), F.col(f"low_{c}") - margin).otherwise(F.lit(float("-inf"))).alias(f"from_{c}") for c in _AXES],
        *[F.when(F.col(f"high_{c}") + margin < F.col(f"all_high_{c}"), F.col(f"high_{c}") + margin).otherwise(F.lit(float("inf"))).alias(f"to_{c}") for c in _AXES],
    )
    around = stored(around)
    halo = around.withColumnRenamed("block", "home")
    for depth, boxes in enumerate(levels):
        meets = reduce(lambda a, b: a & b, [(F.col(f"low_{c}") <= F.col(f"to_{c}")) & (F.col(f"high_{c}") >= F.col(f"from_{c}")) for c in _AXES])
        halo = halo.join(boxes, [key, *_PATH[:depth]]).where(meets).drop(*[f"{s}_{c}" for s in ("low", "high") for c in _AXES])
    halo = stored(halo.select(key, "home", *_PATH))
    crowded = stored(halo.groupBy(key, "home").count().where(F.col("count") > _AROUND).select(key, F.col("home").alias("block"), F.lit(True).alias("crowded")))
    none = {f"{side}_{c}": F.when(F.col("crowded"), F.lit(float(far))).otherwise(F.col(f"{side}_{c}")) for c in _AXES for side, far in (("from", "inf"), ("to", "-inf"))}
    around = stored(around.join(crowded, [key, "block"], "left").withColumns(none).drop("crowded"))
    halo = halo.join(around.withColumnRenamed("block", "home").drop("extent"), [key, "home"])
    inside = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"from_{c}"), F.col(f"to_{c}")) for c in _AXES])
    own = F.col("home") == F.col("block")
    halo = halo.join(points, [key, *_PATH]).where(own | inside).select(key, F.col("home").alias("block"), "pos", *_AXES, own.alias("own"))
    corners = leaf.select(key, "block").join(frame, key).select(key, "block", F.explode(F.array("a", "b", "c", "d")).alias("p")).select(key, "block", "p.*", F.lit(False).alias("own"))
    once = halo.unionByName(corners).groupBy(key, "block", "pos").agg(*[F.first(c).alias(c) for c in _AXES], F.max("own").alias("own"))

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, block long, ghost boolean, certified boolean, first boolean, i1 long, i2 long, i3 long, i4 long, at array<double>, " + ", ".join(f"{n} double" for n in ("cx", "cy", "cz", "r", "nx", "ny", "nz", "slack"))
    active, done, tasks = stored(once), [], min(max(leaf.count(), 1), _TASKS)
    while True:
        dealt = active.join(around, [key, "block"]).repartition(tasks, key, "block")  # by number: blocks are small, but slow, and Spark merges small partitions
        cells = stored(dealt.groupBy(key, "block").applyInPandas(_star(key), schema))
        new = stored(_found(cells.where(~F.col("certified")), points, levels, key))
        again = new.select(key, "block").distinct()
        four = F.array_sort(F.array("i1", "i2", "i3", "i4"))
        done.append(cells.where("first").join(again, [key, "block"], "left_anti").select(key, *[four[k].alias(f"i{k + 1}") for k in range(4)]))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, done)
        active = stored(active.join(again, [key, "block"], "left_semi").unionByName(new.withColumn("own", F.lit(False))))
