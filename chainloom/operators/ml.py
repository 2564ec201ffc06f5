"""Models on ``pyspark.ml`` and native evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .sampling import folds, ranked


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="skip").transform(df)


def kmeans_labels(df: DataFrame, label: str, k: int = 2, seed: int = 1) -> DataFrame:
    """Add ``cluster`` and ``predicted``, the most frequent label of its cluster (the smaller of equals)."""
    done = KMeans(k=k, seed=seed, predictionCol="cluster").fit(df).transform(df)
    counts = done.groupBy("cluster", label).count()
    best = counts.groupBy("cluster").agg(F.min_by(label, F.struct(-F.col("count"), label)).alias("predicted"))
    return done.join(F.broadcast(best), "cluster")  # k rows


def silhouette(df: DataFrame, id_: str, features: str, cluster: str) -> DataFrame:
    """Squared-Euclidean silhouette of each row, from each cluster's size, sum and sum of squares alone."""
    rows = df.withColumn("_x", vector_to_array(features))
    square = F.aggregate("_x", F.lit(0.0), lambda t, v: t + v * v)
    dims = rows.select(cluster, square.alias("q"), F.posexplode("_x").alias("d", "v"))
    sums = dims.groupBy(cluster, "d").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    stat = sums.groupBy(cluster).agg(F.max("n").alias("n"), F.max("q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda t: t["s"]).alias("s"))
    stat = stat.withColumnRenamed(cluster, "_c")
    all_ = rows.withColumn("_q", square).crossJoin(F.broadcast(stat))  # a row a cluster
    dot = F.aggregate(F.zip_with("_x", "s", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    total = F.col("n") * F.col("_q") - 2 * dot + F.col("q")
    own = F.col("_c") == F.col(cluster)
    mean = total / F.when(own, F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("n"))
    out = all_.groupBy(id_, cluster).agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    return out.select(id_, cluster, F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


_CLOSE = 1e-2  # squared distances under this part of the squares lose digits as a difference of products


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` to all of ``y``: by products, and by differences where rows are close."""
    middle = y.mean(axis=0)
    p, q = x - middle, y - middle
    size = (p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1)
    gap = size - 2 * (p @ q.T)
    i, j = np.nonzero(gap <= _CLOSE * size)
    for a in range(0, len(i), 1 << 16):
        u, v = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        gap[u, v] = ((x[u] - y[v]) ** 2).sum(axis=1)
    return np.sqrt(gap)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile as one row: its rows' ids and clusters, in order of the clusters, and their vectors as bytes."""
    pdf = pdf.sort_values(["cluster", "row"])
    return pd.DataFrame({"t": pdf["t"].iloc[:1].to_numpy(), "row": [pdf["row"].to_numpy()], "cluster": [pdf["cluster"].to_numpy()], "x": [np.stack(pdf["x"].to_list()).tobytes()]})


def _distance_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For pairs of tiles, sums of distances from each row of either to each cluster's rows of the other."""
    for pdf in batches:
        for same, *tiles in zip(pdf["t"] == pdf["u"], pdf["row"], pdf["cluster"], pdf["x"], pdf["row2"], pdf["cluster2"], pdf["x2"]):
            sides = [(np.asarray(r), np.asarray(c), np.frombuffer(x).reshape(len(r), -1)) for r, c, x in (tiles[:3], tiles[3:])]
            gap = _distances(sides[0][2], sides[1][2])
            for (row, own, _), (_, cluster, _), d in ((*sides, gap), (*sides[::-1], gap.T))[: 1 if same else 2]:
                starts = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
                n, k = len(row), len(starts)
                total = np.add.reduceat(d, starts, axis=1)
                yield pd.DataFrame({"row": np.repeat(row, k), "own": np.repeat(own, k), "cluster": np.tile(cluster[starts], n), "total": total.reshape(-1), "n": np.tile(np.diff(np.append(starts, len(cluster))), n)})


def euclidean_silhouette(df: DataFrame, id_: str, features: str, cluster: str, tile: int = 2048, together: int = 8) -> DataFrame:
    """Exact Euclidean silhouette of every row; ids must be unique, and rows without a cluster are left out.

    Rows are cut into tiles of about ``tile`` rows in order of their clusters, and written as one row
    each.  A task has every pair of two lists of about ``together`` tiles, which it reads where they
    are: no pair of tiles or rows is written or shuffled, only sums of distances by cluster.
    """
    rows = df.where(F.col(cluster).isNotNull()).select(F.col(id_).alias("row"), F.col(cluster).alias("cluster"), vector_to_array(features).alias("x"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("row", "cluster")}
    dealt = ranges.ranked(rows, ["cluster", "row"]).withColumn("t", F.floor(F.col("_rank") / tile)).drop("_rank")
    tiles = ranges.stored(dealt.groupBy("t").applyInPandas(_pack, f"t long, row array<{kinds['row']}>, cluster array<{kinds['cluster']}>, x binary"))
    lists = math.ceil(max(tiles.count(), 1) / together)
    ranges.bound_batches(df.sparkSession)
    left = tiles.repartition(lists)
    right = left.withColumnsRenamed({"t": "u", "row": "row2", "cluster": "cluster2", "x": "x2"})
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.col("t") <= F.col("u"))
    sums = pairs.mapInPandas(_distance_sums, f"row {kinds['row']}, own {kinds['cluster']}, cluster {kinds['cluster']}, total double, n long")
    whole = sums.groupBy("row", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("cluster")
    n = F.col("n") - same.cast("int")  # a row is no neighbour of itself
    out = whole.withColumn("d", F.when(n > 0, F.col("total") / n)).groupBy("row", "own").agg(F.max(F.when(same, F.col("d"))).alias("a"), F.min(F.when(~same, F.col("d"))).alias("b"))
    larger = F.greatest("a", "b")
    ratio = (F.col("b") - F.col("a")) / F.when(larger != 0, larger).otherwise(float("nan"))  # all rows at one place: as 0 / 0 in SQL
    return out.select(F.col("row").alias(id_), F.col("own").alias(cluster), F.when(F.col("a").isNull(), 0.0).otherwise(ratio).alias("silhouette"))


def principal_components(df: DataFrame, k: int = 2, name: str = "components") -> DataFrame:
    return PCA(k=k, inputCol="features", outputCol=name).fit(df).transform(df)


def random_fourier(df: DataFrame, features: str, dims: int, gamma: float, seed: int = 0, out: int = 64, name: str = "fourier") -> DataFrame:
    """Random Fourier features of the radial kernel exp(-gamma |x - y|^2) (Rahimi, Recht 2007), as expressions."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (out, dims)), rng.uniform(0, 2 * math.pi, out)
    x = vector_to_array(features)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in np.column_stack((w, b))])
    rows = df.withColumn("_x", F.concat(x, F.array(F.lit(1.0))))
    dot = lambda row: F.aggregate(F.zip_with(row, F.col("_x"), lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    return rows.withColumn(name, array_to_vector(F.transform(table, lambda row: F.cos(dot(row)) * math.sqrt(2 / out)))).drop("_x")


def kernel_svm(df: DataFrame, label: str, dims: int, gamma: float, seed: int = 0, others: DataFrame | None = None) -> DataFrame:
    """A support vector machine with an approximate radial kernel: adds ``prediction`` and ``rawPrediction`` to ``others``, or to ``df``."""
    lift = lambda rows: random_fourier(rows, "features", dims, gamma, seed)
    model = LinearSVC(featuresCol="fourier", labelCol=label, maxIter=50, regParam=0.01).fit(lift(df))
    return model.transform(lift(df if others is None else others))


def decision_grid(df: DataFrame, x: str, y: str, label: str, gamma: float, side: int = 30, seed: int = 0) -> DataFrame:
    """i, j, x, y and the decision value on an even grid over two columns, for contours at -1, 0 and 1."""
    lo_hi = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in (x, y) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    at = lambda c, k: lo_hi[f"{c}_lo"] + (lo_hi[f"{c}_hi"] - lo_hi[f"{c}_lo"]) * F.col(k) / (side - 1)
    cells = df.sparkSession.range(side * side).select(F.expr(f"CAST(id div {side} AS INT)").alias("i"), (F.col("id") % side).cast("int").alias("j"))
    cells = assemble(cells.withColumns({x: at(x, "i"), y: at(y, "j")}), [x, y])
    out = kernel_svm(assemble(df, [x, y]), label, 2, gamma, seed, cells)
    return out.select("i", "j", x, y, vector_to_array("rawPrediction")[1].alias("decision"))


def logistic(df: DataFrame, label: str, features: str = "features", iterations: int = 1000) -> LogisticRegression:
    """L2 logistic regression with unit penalty on the summed loss."""
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=iterations, regParam=1 / max(df.count(), 1), elasticNetParam=0.0, standardization=False).fit(df)


def eliminate_features(df: DataFrame, columns: list[str], label: str, keep: int = 2, iterations: int = 1000, step: float = 0.0) -> list[str]:
    """Fit, drop the column with the least weight (or the share ``step`` of those left), and again until ``keep`` are left; loops over columns, not rows."""
    left = list(columns)
    while len(left) > keep:
        weight = np.abs(logistic(assemble(df, left, "_f"), label, "_f", iterations).coefficients.toArray())
        gone = set(np.argsort(weight, kind="stable")[: min(max(1, int(len(left) * step)), len(left) - keep)].tolist())
        left = [c for k, c in enumerate(left) if k not in gone]
    return left


def probability(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def roc_points(df: DataFrame, score: str, label: str, cells: int = 4096) -> DataFrame:
    """threshold, tpr, fpr: one row a distinct score, counted before the running sums.

    The running sums go by ``cells`` ranges of the scores first, so a continuous
    score, with a threshold for almost every row, is not summed by one task.
    """
    truth = F.col(label).cast("long")
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(truth).alias("p"), F.sum(1 - truth).alias("n"))
    edge = df.agg(F.min(score).cast("double").alias("_lo"), F.max(score).cast("double").alias("_hi"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("threshold") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells)).otherwise(0)
    counts = counts.crossJoin(F.broadcast(edge)).withColumn("_cell", cell).drop("_lo", "_hi")  # one row
    above, all_ = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = counts.groupBy("_cell").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # at most a row a cell
    sums = sums.select("_cell", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in ("_p", "_n")], *[F.sum(c).over(all_).alias(f"{c}_all") for c in ("_p", "_n")])
    down = Window.partitionBy("_cell").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(F.broadcast(sums), "_cell").select(
        "threshold", *[((F.col(f"_{c}_before") + F.sum(c).over(down)) / F.nullif(F.col(f"_{c}_all"), F.lit(0))).alias(n) for c, n in (("p", "tpr"), ("n", "fpr"))]
    )


def smooth_gaussian(df: DataFrame, order: str, value: str, sigma: float = 2.0, reach: int = 8, size: int = ranges.SIZE) -> DataFrame:
    """Add ``smoothed``: a Gaussian-weighted mean over neighbouring rows; a row's weights are made to sum to one.

    Ties of ``order`` go by value.  Rows are smoothed in blocks of ``size`` that share ``reach`` rows.
    """
    df, w = ranges.blocks(df, [order, value], reach, reach, size), Window.partitionBy("_block").orderBy("_rank")
    top, bottom = None, None
    for d in range(-reach, reach + 1):
        near = F.lag(value, d).over(w) if d > 0 else F.lead(value, -d).over(w) if d else F.col(value)
        k = math.exp(-d * d / (2 * sigma * sigma))
        top = F.coalesce(near * k, F.lit(0.0)) if top is None else top + F.coalesce(near * k, F.lit(0.0))
        bottom = F.when(near.isNotNull(), k).otherwise(0.0) if bottom is None else bottom + F.when(near.isNotNull(), k).otherwise(0.0)
    return ranges.owned(df.withColumn("smoothed", top / bottom))


def area_under(roc: DataFrame) -> DataFrame:
    """Area under ROC points by trapezoids.

    Rows are paired with the one before by their rank in ranges of the false positive
    rate; each range's first row takes the last of the range before from a table of a row a range.
    """
    cell = F.floor(F.col("fpr") * 4096).alias("_cell")
    rows = roc.select("threshold", "fpr", "tpr", cell)
    w = Window.partitionBy("_cell").orderBy(F.desc("threshold"))
    ends = rows.groupBy("_cell").agg(F.min_by(F.struct("fpr", "tpr"), "threshold").alias("e"))
    before = ends.select("_cell", F.lag("e").over(Window.orderBy("_cell")).alias("_b"))
    rows = rows.join(F.broadcast(before), "_cell")
    x0, y0 = (F.coalesce(F.lag(c).over(w), F.col(f"_b.{c}"), F.lit(0.0)) for c in ("fpr", "tpr"))
    return rows.select(((F.col("fpr") - x0) * (F.col("tpr") + y0) / 2).alias("a")).agg(F.sum("a").alias("auc"))


def decision_tree_accuracy(df: DataFrame, id_: str, label: str, seeds: int = 5, depth: int = 5) -> DataFrame:
    """seed, accuracy on the fifth of the rows that a seeded order holds out."""
    from .sampling import split_exact

    rows = []
    for seed in range(seeds):
        parts = split_exact(df, id_, 0.8, seed)
        model = DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=seed).fit(parts.where("part = 'train'"))
        tested = model.transform(parts.where("part = 'test'"))
        rows.append(tested.agg(F.lit(seed).alias("seed"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def perceptron(layers: list[int], label: str, seed: int = 0, iterations: int = 100) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=layers, labelCol=label, seed=seed, maxIter=iterations)


def cross_validate(df: DataFrame, id_: str, label: str, estimator, k: int = 10, seed: int = 0) -> DataFrame:
    """fold, accuracy for each of ``k`` folds."""
    parts = folds(df, id_, k, seed).cache()
    out = None
    for fold in range(k):
        done = estimator.fit(parts.where(F.col("fold") != fold)).transform(parts.where(F.col("fold") == fold))
        row = done.agg(F.lit(fold).alias("fold"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support; a value without rows to divide by is 0."""
    both = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col(label) == F.col(predicted)).cast("int").alias("hit"))
    stat = both.groupBy(F.col("s.c").alias("label")).agg(F.sum(F.col("s.t") * F.col("hit")).alias("tp"), F.sum("s.t").alias("support"), F.sum("s.p").alias("named"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = stat.withColumns({"precision": ratio(F.col("tp"), F.col("named")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support").where("support > 0")


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def dealing(n: int, columns: int, seed: int = 0) -> list[tuple[int, int]]:
    """For each column factor and offset of a permutation of 0 to n - 1: place r goes to (factor * r + offset) mod n."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(columns):
        factor = int(rng.integers(1, 1 << 20))
        while math.gcd(factor, n) > 1:
            factor += 1
        out.append((factor, int(rng.integers(0, max(n, 1)))))
    return out


def permutation_importance(df: DataFrame, id_: str, columns: list[str], score: Column, label: str, seed: int = 0) -> DataFrame:
    """column, drop in accuracy of ``score > 0`` when the column's values are dealt anew.

    Rows have places in a seeded order, and each column's values move to other places
    by its own permutation of them; one shuffle carries all columns.
    """
    placed = ranked(df.select(id_, label, *columns), id_, seed, name="_p").withColumn("_p", F.col("_p") - 1)
    n = df.count()
    moves = [F.struct(F.lit(k).alias("c"), F.pmod(F.col("_p") * a + b, F.lit(n)).alias("to"), F.col(c).cast("double").alias("v")) for k, (c, (a, b)) in enumerate(zip(columns, dealing(max(n, 1), len(columns), seed)))]
    moved = placed.select(F.explode(F.array(*moves)).alias("m")).groupBy(F.col("m.to").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("m.c", "m.v"))).alias("_y"))
    each = placed.join(moved, "_p").select(label, *columns, "_y", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1))).alias("_c"))
    rows = each.select("_c", label, *[F.when(F.col("_c") == k, F.col("_y")[k]["v"]).otherwise(F.col(c)).alias(c) for k, c in enumerate(columns)])
    right = ((score > 0) == (F.col(label) == 1)).cast("double")
    out = rows.groupBy("_c").agg(F.avg(right).alias("accuracy"))  # a row a column
    base = F.max(F.when(F.col("_c") == -1, F.col("accuracy"))).over(Window.partitionBy())
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_c") + 1)
    return out.withColumn("importance", base - F.col("accuracy")).where("_c >= 0").select(named.alias("column"), "importance")
