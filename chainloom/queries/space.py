"""Registered queries: geometry and tessellation of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions import geometry as G
from chainloom.functions.lookup import HYDROPATHIES, VOLUME
from chainloom.operators import cells, spatial, stats, windows
from chainloom.plans import strand

from .views import FOUR_SQL, POINT_SQL, point, residue

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_QUAD_SQL = POINT_SQL + ", quad AS (SELECT chain, pos, " + ", ".join(
    f"lead({c}, {k}) OVER w AS {c}{k + 1}" for k in range(4) for c in "xyz"
) + " FROM point WINDOW w AS (PARTITION BY chain ORDER BY pos))"


def _edge_sql(i: int, j: int) -> str:
    return "round(sqrt(" + " + ".join(f"({c}{i} - {c}{j}) * ({c}{i} - {c}{j})" for c in "xyz") + "), 3)"


_PAIRS = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
_DET = "+".join(
    f"{s}({a}1-{a}2)*({b}2-{b}3)*({c}3-{c}4)" for s, a, b, c in (("", "x", "y", "z"), ("", "y", "z", "x"), ("", "z", "x", "y"))
) + "".join(f"-({a}1-{a}2)*({b}2-{b}3)*({c}3-{c}4)" for a, b, c in (("x", "z", "y"), ("y", "x", "z"), ("z", "y", "x")))
_SQUARES = "+".join(f"(e{i}-e{j})*(e{i}-e{j})" for i in range(1, 6) for j in range(i + 1, 7))
_SUM = "(" + "+".join(f"e{k}" for k in range(1, 7)) + ")"
_TETRA_SQL = _QUAD_SQL + ", edges AS (SELECT chain, pos, " + ", ".join(f"{_edge_sql(i, j)} AS e{k}" for k, (i, j) in enumerate(_PAIRS, 1)) + (
    f", abs({_DET}) / 6 AS volume FROM quad WHERE x4 IS NOT NULL), tetra AS (SELECT *, {_SQUARES} AS q, {_SUM} AS s FROM edges)"
)


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = point(spark, sf_dir).withColumn("p", F.struct("x", "y", "z"))
    return windows.sliding(rows, ["chain"], ["pos"], ["p"], 4).select("chain", "pos", *[f"p{k}" for k in range(1, 5)])


def _tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tetra_metrics(_quads(spark, sf_dir), [f"p{k}" for k in range(1, 5)])


@query(f"WITH {_TETRA_SQL} SELECT chain, pos, e1, e2, e3, e4, e5, e6, round(volume, 3) AS volume, round(q / (15 * (s / 6) * (s / 6)), 3) AS tetrahedrality FROM tetra")
def tetra_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tetra(spark, sf_dir).select("chain", "pos", *[f"e{k}" for k in range(1, 7)], "volume", "tetrahedrality")


@query(f"WITH {_TETRA_SQL} SELECT CAST(c AS DOUBLE) AS cutoff, count(*) AS simplices FROM tetra, (VALUES (0.6), (0.4), (0.3)) AS k(c) WHERE greatest(e1, e2, e3, e4, e5, e6) < c GROUP BY c")
def multi_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_cutoffs(_tetra(spark, sf_dir), [0.6, 0.4, 0.3]).groupBy("cutoff").agg(F.count(F.lit(1)).alias("simplices"))


@query(f"WITH {_TETRA_SQL} SELECT chain, pos FROM tetra WHERE greatest(e1, e2, e3, e4, e5, e6) <= 0.5")
def edge_cutoff_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tetra(spark, sf_dir).where(F.greatest(*[F.col(f"e{k}") for k in range(1, 7)]) <= 0.5).select("chain", "pos")


def _vec_sql(name: str, expr: str, args: tuple[str, ...]) -> str:
    """Three columns of a vector; ``expr`` uses {c} for the axis."""
    return ", ".join(f"{expr.format(c=c)} AS {name}{c}" for c in "xyz")


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a.format(c=c)}) * ({b.format(c=c)})" for c in "xyz") + ")"


def _cross(a: str, b: str, c: str) -> str:
    u, v = {"x": "yz", "y": "zx", "z": "xy"}[c]
    return f"(({a.format(c=u)}) * ({b.format(c=v)}) - ({a.format(c=v)}) * ({b.format(c=u)}))"


def _det(a: str, b: str, n: str) -> str:
    return "(" + " + ".join(f"({a.format(c=c)}) * {_cross(b, n, c)}" for c in "xyz") + ")"


_ANGLE_SQL = _QUAD_SQL + f""",
    a AS (SELECT *, {_vec_sql("l", "({c}1 + {c}2) / 2", ())}, {_vec_sql("m", "({c}2 + {c}3) / 2", ())}, {_vec_sql("n", "({c}3 + {c}4) / 2", ())} FROM quad WHERE x4 IS NOT NULL),
    b AS (SELECT *, {_dot("{c}2 - m{c}", "l{c} - m{c}")} / {_dot("l{c} - m{c}", "l{c} - m{c}")} AS t FROM a),
    c AS (SELECT *, {_vec_sql("r", "m{c} + (l{c} - m{c}) * t", ())}, {_vec_sql("p", "(m{c} + l{c}) / 2", ())}, {_vec_sql("q", "(m{c} + n{c}) / 2", ())} FROM b),
    d AS (SELECT *, {_dot("m{c} - l{c}", "n{c} - r{c}")} / {_dot("m{c} - l{c}", "m{c} - l{c}")} AS k FROM c),
    e AS (SELECT *, {_vec_sql("u", "n{c} - (m{c} - l{c}) * k - r{c}", ())}, {_vec_sql("f", "{c}2 - p{c}", ())}, {_vec_sql("g", "q{c} - p{c}", ())}, {_vec_sql("h", "{c}3 - q{c}", ())} FROM d),
    v AS (SELECT *, {", ".join(f"{_cross('f{c}', 'g{c}', c)} AS v{c}, {_cross('h{c}', 'g{c}', c)} AS w{c}" for c in "xyz")} FROM e),
    o AS (SELECT chain, pos, degrees(atan2({_det("g{c}", "v{c}", "w{c}")} / sqrt({_dot("g{c}", "g{c}")}), {_dot("v{c}", "w{c}")})) AS twist,
      degrees(acos(greatest(least({_dot("m{c} - l{c}", "n{c} - m{c}")} / (sqrt({_dot("m{c} - l{c}", "m{c} - l{c}")}) * sqrt({_dot("n{c} - m{c}", "n{c} - m{c}")})), 1.0), -1.0))) AS bend,
      degrees(atan2({_det("{c}2 - r{c}", "u{c}", "r{c} - l{c}")}, {_dot("{c}2 - r{c}", "u{c}")})) AS rot FROM v)"""


@query(f"WITH {_ANGLE_SQL} SELECT chain, pos, round(twist, 4) AS twist, round(bend, 4) AS bend, round(CASE WHEN rot < 0 THEN rot + 360 ELSE rot END, 4) AS rotation FROM o")
def strand_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.strand_angles(_quads(spark, sf_dir), [f"p{k}" for k in range(1, 5)])
    return out.select("chain", "pos", *[F.round(c, 4).alias(c) for c in ("twist", "bend", "rotation")])


@query(f"""WITH {_ANGLE_SQL}, r AS (SELECT CASE WHEN rot < 0 THEN rot + 360 ELSE rot END AS rotation FROM o)
    SELECT CASE WHEN rotation > 180 THEN 'Big' WHEN rotation < 180 THEN 'Small' ELSE CAST(rotation AS VARCHAR) END AS label, count(*) AS rows FROM r GROUP BY 1""")
def rotation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.strand_angles(_quads(spark, sf_dir), [f"p{k}" for k in range(1, 5)])
    return out.groupBy(strand.rotation_label(F.col("rotation")).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


_STAT_SQL = f"{_TETRA_SQL}, sorted AS (SELECT list_sort([e1, e2, e3, e4, e5, e6]) AS e, s / 6 AS ave, volume, round(q / (15 * (s / 6) * (s / 6)), 3) AS t FROM tetra)"


@query(f"""WITH {_STAT_SQL}, long AS (SELECT unnest(['e1', 'e2', 'e3', 'e4', 'e5', 'e6', 'ave', 'volume']) AS metric, unnest([e[1], e[2], e[3], e[4], e[5], e[6], ave, round(volume, 3)]) AS x FROM sorted)
    SELECT metric, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS deviation FROM long GROUP BY metric""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_intervals(spark, sf_dir).select("metric", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query()
def summary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tetra(spark, sf_dir).withColumn("_e", F.array_sort(F.array(*[f"e{k}" for k in range(1, 7)])))
    ave = F.aggregate("_e", F.lit(0.0), lambda t, x: t + x) / 6
    rows = rows.select(*[F.col("_e")[k].alias(f"e{k + 1}") for k in range(6)], ave.alias("ave"), "volume")
    return stats.mean_interval(rows, [*[f"e{k}" for k in range(1, 7)], "ave", "volume"])


_VALUES = ", ".join(f"('{a}', {v}, {HYDROPATHIES[a]})" for a, v in VOLUME.items())
_FEATURE_SQL = f"""{FOUR_SQL}, look AS (SELECT * FROM (VALUES {_VALUES}) AS t(a, v, h)),
    item AS (SELECT chain, pos, u.a, CAST(look.v AS DOUBLE) AS v, CAST(look.h AS DOUBLE) AS h FROM (SELECT chain, pos, unnest(families) AS a FROM four WHERE pos4 IS NOT NULL) u JOIN look ON look.a = u.a)"""


@query(f"""WITH {_FEATURE_SQL} SELECT chain, pos, round(avg(h), 4) AS aa_h_ave, round(avg(v), 4) AS aa_v_ave, round(stddev_samp(v), 4) AS aa_v_std, max(v) AS aa_v_max, min(v) AS aa_v_min,
    string_agg(a, '' ORDER BY v, a) AS by_volume FROM item GROUP BY chain, pos HAVING count(*) = 4""")
def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sliding(residue(spark, sf_dir), ["chain"], ["pos"], ["family"], 4)
    known = rows.where(" AND ".join(f"family{k} IN ({', '.join(repr(a) for a in VOLUME)})" for k in range(1, 5)))
    out = known.select("chain", "pos", *[c.alias(n) for n, c in G.property_features([F.col(f"family{k}") for k in range(1, 5)], VOLUME, HYDROPATHIES).items()])
    return out.select("chain", "pos", *[F.round(c, 4).alias(c) for c in ("aa_h_ave", "aa_v_ave", "aa_v_std")], "aa_v_max", "aa_v_min", F.concat("a1", "a2", "a3", "a4").alias("by_volume"))


def _residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a leaf and a state of their own."""
    rows = point(spark, sf_dir)
    letters = F.array(*[F.lit(a) for a in "ACDEF"])
    return rows.withColumns({"leaf": F.concat(letters[(F.col("vec_id") % 5).cast("int")], (F.col("vec_id") % 2 + 1).cast("string")), "state": F.when(F.col("pos") % 9 < 6, "E").otherwise("H")})


def _bounded(rows: DataFrame, most: int = 400) -> DataFrame:
    """Chains of at most ``most`` points, as real ones are bounded: a label's points in order, cut into pieces."""
    return rows.withColumn("chain", F.col("chain") * 1_000_000 + F.floor((F.col("pos") - 1) / most))


@query()
def delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.tessellate(_bounded(point(spark, sf_dir)), "chain")


@query()
def delaunay_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one set of points."""
    rows = point(spark, sf_dir).select(F.lit(0).alias("chain"), F.col("vec_id").alias("pos"), "x", "y", "z")
    return cells.tessellate_large(rows, "chain")


@query()
def simplex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.simplex_table(delaunay(spark, sf_dir), _bounded(_residues(spark, sf_dir)), "chain", 0.5).drop("leaves")


@query()
def simplex_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.classify(spatial.simplex_table(delaunay(spark, sf_dir), _bounded(_residues(spark, sf_dir)), "chain"), "chain")


_RESIDUE_SQL = "res AS (SELECT chain, pos, vec_id, x, y, z, ['A', 'C', 'D', 'E', 'F'][vec_id % 5 + 1] AS family, ['A', 'C', 'D', 'E', 'F'][vec_id % 5 + 1] || CAST(vec_id % 2 + 1 AS VARCHAR) AS leaf, CASE WHEN pos % 9 < 6 THEN 'E' ELSE 'H' END AS state FROM point)"
_SUMS = ", ".join(f"v[{i}] + v[{j}]" for i in range(1, 4) for j in range(i + 1, 5))


@query(f"""WITH {_ANGLE_SQL}{_TETRA_SQL[len(_QUAD_SQL):]}, {_RESIDUE_SQL}, look AS (SELECT * FROM (VALUES {_VALUES}) AS t(a, v, h)),
    run AS (SELECT chain, pos, [family, lead(family, 1) OVER w, lead(family, 2) OVER w, lead(family, 3) OVER w] AS families, state = 'E' AND lead(state, 1) OVER w = 'E' AND lead(state, 2) OVER w = 'E' AND lead(state, 3) OVER w = 'E' AS hit FROM res WINDOW w AS (PARTITION BY chain ORDER BY pos)),
    item AS (SELECT chain, pos, look.a, CAST(look.v AS DOUBLE) AS v, CAST(look.h AS DOUBLE) AS h FROM (SELECT chain, pos, unnest(families) AS a FROM run WHERE hit) u JOIN look ON look.a = u.a),
    feat AS (SELECT chain, pos, avg(h) AS aa_h_ave, stddev_samp(h) AS aa_h_std, avg(v) AS aa_v_ave, stddev_samp(v) AS aa_v_std, max(v) AS aa_v_max, min(v) AS aa_v_min, list(v ORDER BY v) AS v, list(a ORDER BY v, a) AS a FROM item GROUP BY chain, pos),
    f AS (SELECT *, list_sort([{_SUMS}]) AS p FROM feat), t AS (SELECT *, list_sort([e1, e2, e3, e4, e5, e6]) AS e FROM tetra)
    SELECT {", ".join(f"e[{k}] AS E{k}" for k in range(1, 7))}, round(s / 6, 4) AS Ave, round(q / (15 * (s / 6) * (s / 6)), 3) AS Tetrahedrality, round(volume, 3) AS Volume,
      {", ".join(f"round({c}, 4) AS {c}" for c in ("aa_h_ave", "aa_h_std", "aa_v_ave", "aa_v_std", "aa_v_max", "aa_v_min"))}, {", ".join(f"round(v[{k + 1}], 4) AS v{k}" for k in range(4))},
      {", ".join(f"round(p[{k + 1}], 4) AS v_edge{k}" for k in range(6))}, {", ".join(f"a[{k}] AS a{k}" for k in range(1, 5))},
      round(CASE WHEN rot < 0 THEN rot + 360 ELSE rot END, 4) AS Rotation, round(bend, 4) AS Bend, round(twist, 4) AS Twist FROM f JOIN t USING (chain, pos) JOIN o USING (chain, pos)""")
def strand_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strand.strand_features(strand.four_runs(_residues(spark, sf_dir), F.col("state") == "E", "chain", "pos"))
    return out.select(*[F.round(n, 4).alias(n) if kind == "double" else n for n, kind in out.dtypes])


_FAR_SQL = POINT_SQL + f", {_RESIDUE_SQL}, quad AS (SELECT chain, vec_id, " + ", ".join(
    f"lead({c}, {k}) OVER w AS {n}{k + 1}" for k in range(4) for c, n in (("pos", "r"), ("leaf", "l"), ("state", "s"), ("x", "x"), ("y", "y"), ("z", "z"))
) + " FROM res WHERE vec_id % 7 <> 3 WINDOW w AS (PARTITION BY chain ORDER BY pos)), edges AS (SELECT *, " + ", ".join(f"{_edge_sql(i, j)} AS e{k}" for k, (i, j) in enumerate(_PAIRS, 1)) + (
    f", abs({_DET}) / 6 AS volume FROM quad WHERE x4 IS NOT NULL), tetra AS (SELECT *, {_SQUARES} AS q, {_SUM} AS e FROM edges)"
)


@query(f"""WITH {_FAR_SQL}, d AS (SELECT *, r2 - r1 = 1 AS a, r3 - r2 = 1 AS b, r4 - r3 = 1 AS c, list_sort([{", ".join(f"{{'k': l{k}, 'v': r{k}}}" for k in range(1, 5))}]) AS r, list_sort([{", ".join(f"{{'k': l{k}, 'v': s{k}}}" for k in range(1, 5))}]) AS s FROM tetra)
    SELECT chain, r[1].k || r[2].k || r[3].k || r[4].k AS sorted_simplex, {", ".join(f"r[{k}].v AS r{k}" for k in range(1, 5))}, r4 - r1 - 3 AS residue_distance, round(volume, 3) AS volume, round(q / (15 * (e / 6) * (e / 6)), 3) AS tetrahedrality,
      {", ".join(f"s[{k}].v AS ss{k}" for k in range(1, 5))}, CAST(CASE WHEN a AND b AND c THEN 4 WHEN b AND (a OR c) THEN 3 WHEN a AND c THEN 2 WHEN a OR b OR c THEN 1 ELSE 0 END AS INTEGER) AS class FROM d""")
def classified_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of simplices whose corners are four residues in order, with gaps: positions and states ordered with the leaves."""
    rows = _residues(spark, sf_dir).where("vec_id % 7 <> 3").withColumn("p", F.struct("x", "y", "z")).withColumn("r", F.col("pos"))
    four = G.tetra_metrics(windows.sliding(rows, ["chain"], ["pos"], ["p", "r", "leaf", "state"], 4), [f"p{k}" for k in range(1, 5)])
    leaves = F.array(*[f"leaf{k}" for k in range(1, 5)])
    cells = four.select(
        "chain", F.array_join(F.array_sort(leaves), "").alias("sorted_simplex"), *[f"r{k}" for k in range(1, 5)], G.residue_distance(F.col("r1"), F.col("r4")).alias("residue_distance"),
        "volume", "tetrahedrality", *[F.col(f"state{k}").alias(f"ss{k}") for k in range(1, 5)], leaves.alias("leaves"),
    )
    return spatial.classify(cells, "chain")
