"""Operators on small fixtures."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.operators import assoc, joins, ml, sampling, spatial, stats, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chain(spark, states, key="a"):
    return spark.createDataFrame([(key, i + 1, s) for i, s in enumerate(states)], "chain string, pos int, s string")


def test_run_dedupe(spark):
    df = chain(spark, "1121")
    assert [r[1] for r in rows(windows.run_dedupe(df, ["chain"], ["pos"], "s"))] == [1, 3, 4]


def test_sliding_and_frames(spark):
    df = chain(spark, "EEEEEEHEE")
    assert [r[1] for r in rows(windows.sliding(df, ["chain"], ["pos"], ["s"], 4))] == [1, 2, 3, 4, 5, 6]
    out = windows.context_frame(df, ["chain"], ["pos"], F.col("s") == "E", 2, 1, 1).where("inside")
    assert [(r.pos, r.middle) for r in out.orderBy("pos").collect()] == [(1, False), (2, True), (3, True), (4, True), (5, False), (8, False)]


def test_islands(spark):
    out = windows.islands(chain(spark, "EEHEEE"), ["chain"], ["pos"], "s", "pos").orderBy("pos").collect()
    assert [(r.run_start, r.run_end, r.run_length) for r in out] == [(1, 2, 2), (1, 2, 2), (3, 3, 1), (4, 6, 3), (4, 6, 3), (4, 6, 3)]


@pytest.mark.parametrize("number, want", [(12, 1), (13, 2), (15, 1)])
def test_run_position(spark, number, want):
    assert spark.range(1).select(windows.run_position(F.lit(10), F.lit(20), F.lit(number))).first()[0] == want


@pytest.mark.parametrize("items, want, compat", [("AAAA", 1, 1), ("AAAB", 4, 4), ("AABB", 6, 4), ("AABC", 12, 12), ("ABCD", 24, 24)])
def test_permutation_factor(spark, items, want, compat):
    array = F.array(*[F.lit(c) for c in items])
    r = spark.range(1).select(assoc.permutation_factor(array, 4).alias("a"), assoc.permutation_factor(array, 4, True).alias("b")).first()
    assert (r.a, r.b) == (want, compat) and want == len(set(permutations(items)))


def test_set_log_likelihood(spark):
    df = spark.createDataFrame([(["A1", "A1", "C1", "D1"], 1.0), (["C1", "C1", "C1", "C1"], 3.0)], "items array<string>, v double")
    got = {tuple(r["items"]): r for r in assoc.set_log_likelihood(df, "items", 4, ("v",)).collect()}
    assert got[("A1", "A1", "C1", "D1")].llh == pytest.approx(0.931119, abs=1e-5)
    assert got[("C1",) * 4].llh == pytest.approx(0.515450, abs=1e-5) and got[("C1",) * 4].avg_v == 3
    assert sum(r.frequency for r in got.values()) == pytest.approx(1)
    freq = {r.item: r.frequency for r in assoc.item_frequencies(df, "items").collect()}
    assert freq == {"A1": 0.25, "C1": 0.625, "D1": 0.125}


def test_pairs_and_top(spark):
    df = spark.createDataFrame([("A1", "B1", 1.0), ("B1", "A1", 3.0), ("A1", "A1", 2.0)], "a string, b string, d double")
    got = {r.edge: r for r in assoc.pair_log_likelihood(df, "a", "b", "d").collect()}
    assert got["A1B1"]["count"] == 2 and got["A1B1"].average_length == 2
    assert got["A1A1"].llh == pytest.approx(math.log10((1 / 3) / ((4 / 6) ** 2)))
    ranked = spark.createDataFrame([("AA", 3.0), ("AB", 2.0), ("BB", 1.0)], "e string, llh double")
    top = assoc.identical_in_top(ranked, F.col("e"), F.col("e").isin("AA", "BB"), [F.desc("llh")], (1, 2, 3))
    assert rows(top) == [(1, 1), (2, 1), (3, 2)]
    twice = spark.createDataFrame([("x", 1, 2, 9, 0.5), ("x", 1, 2, 3, 0.7)], "c string, a int, b int, o int, d double")
    assert [r.d for r in assoc.distinct_edges(twice, ["c"], "a", "b", ["o"]).collect()] == [0.7]


def test_expected_counts(spark):
    data = [("A", "A1", c) for c, n in enumerate((2, 1, 1)) for _ in range(n)] + [("A", "A2", c) for c, n in enumerate((2, 3, 1)) for _ in range(n)] + [("M", "M1", 0)]
    df = spark.createDataFrame(data, "family string, leaf string, c int")
    counts = stats.class_counts(df, ["family", "leaf"], F.col("c"), [0, 1, 2])
    out = {r.leaf: r for r in stats.expected_counts(counts, "family", [0, 1, 2]).collect()}
    assert [out["A1"][f"exp_{c}"] for c in range(3)] == pytest.approx([1.6, 1.6, 0.8]) and [out["A2"][f"exp_{c}"] for c in range(3)] == pytest.approx([2.4, 2.4, 1.2])
    tested = {(r.family, r["class"]): r for r in stats.with_p_value(stats.chi_square_families(counts, "family", [0, 1, 2])).collect()}
    assert tested["A", 0].x2 == pytest.approx(0.16 / 1.6 + 0.16 / 2.4) and tested["A", 0].df == 1 and 0 < tested["A", 0].p < 1
    assert tested["M", 0].x2 is None and tested["M", 0].p is None
    roll = stats.rollup_counts(df, "family", "leaf", F.col("c"), [0, 1, 2])
    assert [(r.obs_0, r.obs_1, r.obs_2) for r in roll.where("level = 'family' AND family = 'A'").collect()] == [(4, 4, 2)]


def test_intervals_and_histograms(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 90.0), (3.0, 45.0)], "v double, a double")
    r = stats.mean_interval(df, ["v"]).first()
    assert (r.mean, r.deviation) == (2, 1) and r.half_width == pytest.approx(4.302653 / math.sqrt(3), abs=1e-5)
    q = stats.quadrant_counts(df, F.col("a")).first()
    assert (q.q1, q.q2, q.right_half) == (1, 0, 1)  # borders count nowhere
    assert rows(stats.histogram_2d(df, "v", "a", 2)) == [(0, 0, 1), (1, 1, 2)]
    sweep = stats.threshold_sweep(df, "v", F.col("v") > 2, 0, 4, 1.0).orderBy("j").collect()
    assert [x.accuracy for x in sweep] == pytest.approx([1 / 3, 2 / 3, 1, 2 / 3])
    dens = stats.kernel_density(df, "v", 200).orderBy("i").collect()
    h = 3 ** -0.2
    want = sum(math.exp(-(((dens[7].x - v) / h) ** 2) / 2) for v in (1, 2, 3)) / (3 * h * math.sqrt(2 * math.pi))
    assert dens[7].density == pytest.approx(want)


def test_counts_against_counts(spark):
    df = spark.createDataFrame([("a", "a1", 12, 10), ("a", "a2", 8, 10), ("m", "m1", 3, 3), ("z", "z1", 1, 0), ("z", "z2", 1, 2)], "f string, l string, o long, e long")
    got = {r.f: (r.x2, r.df) for r in stats.chi_square_against(df, "f", "o", "e").collect()}
    assert got == {"a": (pytest.approx(0.8), 1), "z": (None, 1)}
    parts = stats.bucket_composition(spark.createDataFrame([(["H", "G", "C"],), (["E", "H", "Q"],)], "s array<string>"), F.col("s"), {"helix": ["H", "G"], "sheet": ["E"], "none": ["N"]})
    assert [tuple(r) for r in parts.collect()] == [("none", 0, 0.0), ("sheet", 1, 0.25), ("helix", 3, 0.75)]


def test_sampling(spark):
    wide = sampling.one_hot(spark.createDataFrame([("b",), ("a",), (None,)], "c string"), "c")
    assert wide.columns == ["c", "c_a", "c_b"] and rows(wide.where("c = 'a'")) == [("a", 1, 0)]
    with pytest.raises(ValueError):
        sampling.one_hot(spark.range(9).select(F.col("id").cast("string").alias("c")), "c", most=5)
    df = spark.range(300).select("id", F.when(F.col("id") < 50, "a").otherwise("b").alias("c"))
    assert rows(sampling.balanced_sample(df, "id", "c").groupBy("c").count()) == [("a", 50), ("b", 50)]
    parts = sampling.split_exact(df, "id", 0.8)
    assert rows(parts.groupBy("part").count()) == [("test", 60), ("train", 240)]
    assert rows(parts) == rows(sampling.split_exact(df.repartition(7), "id", 0.8))
    assert {r["count"] for r in sampling.folds(df, "id", 10).groupBy("fold").count().collect()} == {30}
    z = sampling.standardize(df.select("id", F.col("id").cast("double").alias("x")), ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_large_classes_are_balanced_whole(spark):
    """Classes of more than a million rows keep as many as the smallest has."""
    df = spark.range(2_100_020).select("id", F.when(F.col("id") < 1_050_000, "a").otherwise("b").alias("c"))
    assert rows(sampling.balanced_sample(df, "id", "c").groupBy("c").count()) == [("a", 1_050_000), ("b", 1_050_000)]


def test_large_classes_are_prepared_whole(spark):
    """No row of a balanced table of more than a million a class is left out of the training set."""
    df = spark.range(2_000_020).select("id", (F.col("id") % 2).cast("string").alias("c"), F.col("id").cast("double").alias("x"), F.lit("t").alias("t"))
    got = sampling.prepare(df, "id", "c", ["x"], ["t"]).groupBy("part").count()
    assert rows(got) == [("test", 400_004), ("train", 1_600_016)]


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "k int, o int, v string")
    assert [(r.k, r.v) for r in joins.last_match(a, b, ["k"], ["o"]).orderBy("k").collect()] == [(1, "y"), (2, None)]
    assert [(r.k, r.v) for r in joins.first_match(a, b, ["k"], ["o"]).orderBy("k").collect()] == [(1, "x"), (2, None)]
    good, bad = joins.split_rejects(a, b, ["k"], "none")
    assert good.count() == 2 and [tuple(r) for r in bad.collect()] == [(2, "none")]


def test_delaunay_properties():
    p = np.random.default_rng(3).random((40, 3))
    cells = spatial.delaunay(p)
    sides = p[cells[:, 1:]] - p[cells[:, :1]]
    centre = np.linalg.solve(sides, (sides**2).sum(axis=2)[..., None] / 2)[..., 0]
    centre, r2 = p[cells[:, 0]] + centre, (centre**2).sum(axis=1)
    inside = ((p[None] - centre[:, None]) ** 2).sum(axis=2) < r2[:, None] * (1 - 1e-9)
    assert not inside.any()  # every circumsphere is empty
    volume = np.abs(np.linalg.det(p[cells[:, 1:]] - p[cells[:, :1]])).sum() / 6
    cube = spatial.delaunay(np.vstack((np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)]) + np.random.default_rng(1).normal(0, 1e-6, (8, 3)), p)))
    q = np.vstack((np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], dtype=float), p))
    assert volume < 1 and np.abs(np.linalg.det(q[cube[:, 1:]] - q[cube[:, :1]])).sum() / 6 == pytest.approx(1, abs=1e-3)


def test_tessellate_tables(spark):
    p = np.random.default_rng(5).random((12, 3)).tolist()
    data = [("c", i + 1, *xyz, f"A{i % 2 + 1}", "E") for i, xyz in enumerate(p)] + [("flat", i, float(i), 0.0, 0.0, "A1", "E") for i in range(5)]
    df = spark.createDataFrame(data, "chain string, pos long, x double, y double, z double, leaf string, state string")
    cells = spatial.tessellate(df, "chain")
    assert {r.chain for r in cells.collect()} == {"c"}
    table = spatial.simplex_table(cells, df, "chain")
    assert table.count() == cells.count() and table.where("r1 >= r2 OR r2 >= r3 OR r3 >= r4").count() == 0
    assert spatial.classify(table, "chain").where("class NOT BETWEEN 0 AND 4").count() == 0
    longest = F.greatest(*[F.col(f"e{k}") for k in range(1, 7)])
    assert spatial.within_cutoffs(table, [0.5, 9.0]).where("cutoff = 0.5").count() == table.where(longest < 0.5).count()


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(x), float(y), float(x + 0.2 * y > 0)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))]
    df = ml.assemble(spark.createDataFrame(data, "id long, x double, y double, label double"), ["x", "y"])
    done = ml.probability(ml.logistic(df, "label").transform(df))
    assert ml.accuracy(done, "label", "prediction").first()[0] > 0.95
    assert ml.area_under(ml.roc_points(done, "score", "label")).first()[0] > 0.98
    assert sum(r["count"] for r in ml.confusion(done, "label", "prediction").collect()) == 200
    report = {r.label: r for r in ml.class_report(done, "label", "prediction").collect()}
    assert report[1.0].support + report[0.0].support == 200 and report[1.0].f1 > 0.9
    assert ml.eliminate_features(df.drop("features"), ["x", "y"], "label", 1) == ["x"]
    score = F.col("x") + 0.2 * F.col("y")
    drop = {r.column: r.importance for r in ml.permutation_importance(df.drop("features"), "id", ["x", "y"], score, "label").collect()}
    assert drop["x"] > drop["y"]
    two = ml.kmeans_labels(df, "label", 2)
    s = ml.silhouette(two, "id", "features", "cluster").collect()
    assert len(s) == 200 and all(-1 <= r.silhouette <= 1 for r in s)
    assert ml.accuracy(ml.kernel_svm(df, "label", 2, 0.5), "label", "prediction").first()[0] > 0.85
    grid = ml.decision_grid(df.drop("features"), "x", "y", "label", 0.5, 5).collect()
    assert len(grid) == 25 and min(r.decision for r in grid) < 0 < max(r.decision for r in grid)
    x, label = np.array([d[1:3] for d in data]), np.array([d[3] for d in data])
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    for tile in (2048, 30):
        rows = ml.euclidean_silhouette(df, "id", "features", "label", tile).collect()
        assert len(rows) == 200
        for r in rows:
            same = label == label[r.id]
            a, b = gap[r.id][same].sum() / (same.sum() - 1), gap[r.id][~same].mean()
            assert r.silhouette == pytest.approx((b - a) / max(a, b))


def test_silhouette_of_large_clusters(spark):
    """More than 2000 rows in a cluster, one cluster of one row, a null cluster."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2602, 3))
    names = ["big" if k < 2300 else "small" for k in range(2600)] + ["one", None]
    df = ml.assemble(spark.createDataFrame([(k, *map(float, p), c) for k, (p, c) in enumerate(zip(x, names))], "id long, a double, b double, c double, name string"), ["a", "b", "c"])
    got = {r.id: r.silhouette for r in ml.euclidean_silhouette(df, "id", "features", "name").collect()}
    assert sorted(got) == list(range(2601)) and got[2600] == 0.0
    where = {c: np.array([k for k, n in enumerate(names) if n == c]) for c in ("big", "small", "one")}
    for k in range(0, 2600, 37):
        d = {c: np.linalg.norm(x[at] - x[k], axis=1).sum() / (len(at) - (names[k] == c)) for c, at in where.items() if names[k] != c or len(at) > 1}
        a, b = d.pop(names[k]), min(d.values())
        assert got[k] == pytest.approx((b - a) / max(a, b))


def test_silhouette_over_partitions(spark):
    """No pair of tiles is lost where shuffles keep their partitions; close, far-shifted and equal vectors keep their distances."""
    rng = np.random.default_rng(6)
    x = np.vstack((rng.normal(size=(200, 3)), 1e6 + rng.normal(0, 1e-3, (200, 3))))
    x[300:340] = x[300]
    label = np.arange(400) % 3
    df = ml.assemble(spark.createDataFrame([(k, *map(float, p), int(c)) for k, (p, c) in enumerate(zip(x, label))], "id long, a double, b double, c double, name int"), ["a", "b", "c"])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = {r.id: r.silhouette for r in ml.euclidean_silhouette(df, "id", "features", "name", 30).collect()}
    finally:
        spark.conf.set(key, before)
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert sorted(got) == list(range(400))
    for k in range(400):
        d = {c: gap[k][label == c].sum() / ((label == c).sum() - (label[k] == c)) for c in range(3)}
        a, b = d.pop(label[k]), min(d.values())
        assert got[k] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    one_place = df.withColumns({c: F.lit(1.0) for c in "abc"}).drop("features").limit(9)
    assert all(math.isnan(r.silhouette) for r in ml.euclidean_silhouette(ml.assemble(one_place, ["a", "b", "c"]), "id", "features", "name").collect())


def test_silhouette_shuffles_no_pairs(spark):
    """Pairs of tiles are read where they are; what is shuffled grows with the rows and not with their pairs."""
    df = ml.assemble(spark.range(400).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 3).alias("name")), ["a", "b"])
    plan = ml.euclidean_silhouette(df, "id", "features", "name", 30)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroups" not in plan


def test_roc_over_many_scores(spark):
    """Running sums by ranges agree with one sort, ties and nulls included."""
    rng = np.random.default_rng(1)
    data = [(float(np.round(s, 3)), int(y)) for s, y in zip(rng.normal(size=3000), rng.integers(0, 2, 3000))]
    df = spark.createDataFrame(data + [(None, 1)], "s double, y int")
    got = {r.threshold: (r.tpr, r.fpr) for r in ml.roc_points(df, "s", "y", 50).collect()}
    s, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    assert all(got[t] == (pytest.approx(y[s >= t].sum() / y.sum()), pytest.approx((1 - y[s >= t]).sum() / (1 - y).sum())) for t in np.unique(s)) and len(got) == len(np.unique(s))
    auc = ((s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean())
    assert ml.area_under(ml.roc_points(df, "s", "y", 50)).first()[0] == pytest.approx(auc)
    assert ml.roc_points(spark.createDataFrame([], "s double, y int"), "s", "y").count() == 0
