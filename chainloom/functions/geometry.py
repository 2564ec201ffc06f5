"""Geometry of 3-D points as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vec:
    """A point or vector of three Columns."""

    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(name: str) -> Vec:
        return Vec(F.col(f"{name}.x"), F.col(f"{name}.y"), F.col(f"{name}.z"))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def scale(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))


def distance(a: Vec, b: Vec, digits: int = 3) -> Column:
    return F.round((a - b).norm(), digits)


def determinant(a: Vec, b: Vec, c: Vec) -> Column:
    return a.dot(b.cross(c))


def tetra_volume(a: Vec, b: Vec, c: Vec, d: Vec, digits: int = 3) -> Column:
    return F.round(F.abs(determinant(a - b, b - c, c - d)) / 6, digits)


def tetrahedrality(edges: list[Column], digits: int = 3) -> Column:
    """How far six edges are from equal: squared differences of all pairs over 15 squared means."""
    mean = sum(edges[1:], edges[0]) / 6
    pairs = [F.pow(edges[i] - edges[j], F.lit(2)) for i in range(5) for j in range(i + 1, 6)]
    return F.round(sum(pairs[1:], pairs[0]) / (15 * mean * mean), digits)


def tetra_metrics(df: DataFrame, corners: list[str], digits: int = 3) -> DataFrame:
    """Add e1..e6 (ab, ac, ad, bc, bd, cd), volume and tetrahedrality, from rounded edges."""
    p = [Vec.of(c) for c in corners]
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    df = df.withColumns({f"e{k}": distance(p[i], p[j], digits) for k, (i, j) in enumerate(pairs, 1)})
    return df.withColumns({"volume": tetra_volume(*p, digits), "tetrahedrality": tetrahedrality([F.col(f"e{k}") for k in range(1, 7)], digits)})


def midpoint(a: Vec, b: Vec) -> Vec:
    return (a + b).scale(0.5)


def plane(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    """Normal and offset of the plane through three points: normal . p + offset = 0."""
    normal = (b - a).cross(c - a)
    return normal, -normal.dot(a)


def foot_on_plane(normal: Vec, offset: Column, p: Vec) -> Vec:
    return p - normal.scale((normal.dot(p) + offset) / normal.dot(normal))


def foot_on_line(a: Vec, b: Vec, p: Vec) -> Vec:
    along = b - a
    return a + along.scale((p - a).dot(along) / along.dot(along))


def angle(u: Vec, v: Vec) -> Column:
    """Unsigned angle in degrees."""
    return F.degrees(F.acos(F.greatest(F.least(u.dot(v) / (u.norm() * v.norm()), F.lit(1.0)), F.lit(-1.0))))


def turn(u: Vec, v: Vec, normal: Vec) -> Column:
    """Angle from u to v in [0, 360), seen along ``normal``."""
    t = F.degrees(F.atan2(determinant(u, v, normal), u.dot(v)))
    return F.when(t < 0, t + 360).otherwise(t)


def dihedral(p0: Vec, p1: Vec, p2: Vec, p3: Vec) -> Column:
    """Signed torsion in degrees around p1-p2."""
    b0, b1, b2 = p0 - p1, p2 - p1, p3 - p2
    u, w = b0.cross(b1), b2.cross(b1)
    return F.degrees(F.atan2(u.cross(w).dot(b1) / b1.norm(), u.dot(w)))


def strand_angles(df: DataFrame, points: list[str]) -> DataFrame:
    """Add twist, bend and rotation of four consecutive points.

    The frame is built on the midpoints l, m, n of the three steps.  Each stage is
    its own projection, so later expressions refer to columns, not to copies.
    """
    a, b, c, d = (Vec.of(p) for p in points)
    df = df.withColumns({"_l": midpoint(a, b).struct(), "_m": midpoint(b, c).struct(), "_n": midpoint(c, d).struct()})
    lo, mid, hi = Vec.of("_l"), Vec.of("_m"), Vec.of("_n")
    df = df.withColumns({"_r": foot_on_line(mid, lo, b).struct(), "_p": midpoint(mid, lo).struct(), "_q": midpoint(mid, hi).struct()})
    r, along = Vec.of("_r"), mid - lo
    df = df.withColumn("_u", foot_on_plane(along, -along.dot(r), hi).struct())
    df = df.withColumns({
        "twist": dihedral(b, Vec.of("_p"), Vec.of("_q"), c), "bend": angle(along, hi - mid), "rotation": turn(b - r, Vec.of("_u") - r, r - lo),
    })
    return df.drop("_l", "_m", "_n", "_r", "_p", "_q", "_u")


def residue_distance(first: Column, last: Column, size: int = 4) -> Column:
    """Positions between the first and last of ``size`` ordered ones that the others do not fill."""
    return last - first - (size - 1)


def adjacency_class(r: list[Column]) -> Column:
    """Pattern of steps of one among four ascending positions: 4 all, 3 a run of three, 2 two pairs, 1 one pair, 0 none."""
    d = [r[k + 1] - r[k] == 1 for k in range(3)]
    steps = sum((x.cast("int") for x in d[1:]), d[0].cast("int"))
    return F.when(steps == 3, 4).when((steps == 2) & d[1], 3).when(steps == 2, 2).when(steps == 1, 1).otherwise(0)


def property_features(families: list[Column], volume: dict, hydropathy: dict) -> dict[str, Column]:
    """Means, deviations and order statistics of four items' volume and hydropathy; items are ordered by volume."""
    from .lookup import mapped

    v, h = F.array(*[mapped(f, volume) for f in families]), F.array(*[mapped(f, hydropathy) for f in families])

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / 4

    def deviation(a: Column) -> Column:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean(a)) * (x - mean(a))) / 3)

    ordered = F.array_sort(v)
    items = F.array_sort(F.array(*[F.struct(mapped(f, volume).alias("v"), f.alias("a")) for f in families]))
    sums = F.array_sort(F.array(*[mapped(families[i], volume) + mapped(families[j], volume) for i in range(3) for j in range(i + 1, 4)]))
    out = {"aa_h_ave": mean(h), "aa_h_std": deviation(h), "aa_v_ave": mean(v), "aa_v_std": deviation(v), "aa_v_max": F.array_max(v), "aa_v_min": F.array_min(v)}
    out |= {f"v{k}": ordered[k] for k in range(4)}
    out |= {f"v_edge{k}": sums[k] for k in range(6)}
    return out | {f"a{k + 1}": items[k]["a"] for k in range(4)}
