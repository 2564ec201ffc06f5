"""Registered queries: sampling, encodings, models and their evaluation."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators import learners, ml, sampling
from chainloom.session import table

from .views import POINT_SQL, RESIDUE_SQL, point, residue

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_PLACE_SQL = "row_number() OVER (PARTITION BY state ORDER BY md5(CAST(event_id AS VARCHAR) || ':0'), event_id)"


@query(f"""WITH {RESIDUE_SQL}, p AS (SELECT event_id, state, {_PLACE_SQL} AS k FROM residue), n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM residue GROUP BY state))
    SELECT event_id, state FROM p, n WHERE k <= m""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_sample(residue(spark, sf_dir), "event_id", "state").select("event_id", "state")


@query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':0'), event_id) AS k, count(*) OVER () AS n FROM events)
    SELECT event_id, CASE WHEN k <= round(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM p""")
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_exact(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':0'), event_id) AS k FROM events) SELECT event_id, CAST((k - 1) % 10 AS INTEGER) AS fold FROM p""")
def kfold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.folds(table(spark, sf_dir, "events").select("event_id"), "event_id", 10)


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.label_encode(table(spark, sf_dir, "events"), "event_type", "code").select("event_id", "code")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_totalprice) - 1 AS BIGINT) AS code FROM orders")
def label_encode_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for almost every row."""
    return sampling.label_encode(table(spark, sf_dir, "orders"), "o_totalprice", "code", many=True).select("o_orderkey", "code")


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS INTEGER) AS event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")) + " FROM events")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.one_hot(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").drop("event_type")


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.standardize(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])
    return out.select("p_partkey", F.round("p_retailprice", 6).alias("p_retailprice"))


_SCORED_SQL = "scored AS (SELECT d.doc_id, CAST(toxic AS INTEGER) AS label, CAST(n_chars % 50 AS DOUBLE) AS score, CAST(n_chars % 50 > 40 AS INTEGER) AS predicted FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap score with a label; its quality does not matter here, its evaluation does."""
    n = F.col("n_chars") % 50
    rows = table(spark, sf_dir, "documents").select("doc_id", n.cast("double").alias("score"), (n > 40).cast("int").alias("predicted"))
    return rows.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY score)
    SELECT threshold, round(sum(p) OVER w * 1.0 / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER w * 1.0 / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC)""")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.roc_points(_scored(spark, sf_dir), "score", "label").select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY score),
    r AS (SELECT threshold, sum(p) OVER w * 1.0 / sum(p) OVER () AS tpr, sum(n) OVER w * 1.0 / sum(n) OVER () AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC))
    SELECT round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc FROM (SELECT *, coalesce(lag(fpr) OVER w, 0) AS x, coalesce(lag(tpr) OVER w, 0) AS y FROM r WINDOW w AS (ORDER BY threshold DESC))""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.area_under(ml.roc_points(_scored(spark, sf_dir), "score", "label")).select(F.round("auc", 6).alias("auc"))


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT predicted AS threshold, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY predicted),
    r AS (SELECT threshold, sum(p) OVER w * 1.0 / sum(p) OVER () AS tpr, sum(n) OVER w * 1.0 / sum(n) OVER () AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC))
    SELECT round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc FROM (SELECT *, coalesce(lag(fpr) OVER w, 0) AS x, coalesce(lag(tpr) OVER w, 0) AS y FROM r WINDOW w AS (ORDER BY threshold DESC))""")
def roc_auc_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area for hard predictions."""
    return ml.area_under(ml.roc_points(_scored(spark, sf_dir), "predicted", "label")).select(F.round("auc", 6).alias("auc"))


_NEAR = {d: math.exp(-d * d / 8) for d in range(-8, 9)}
_NEAR_SQL = {d: "tpr" if d == 0 else f"{'lag' if d > 0 else 'lead'}(tpr, {abs(d)}) OVER o" for d in _NEAR}


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY score),
    r AS (SELECT threshold, sum(p) OVER w * 1.0 / sum(p) OVER () AS tpr, sum(n) OVER w * 1.0 / sum(n) OVER () AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC)),
    s AS (SELECT *, {" + ".join(f"coalesce({x} * {_NEAR[d]!r}, 0)" for d, x in _NEAR_SQL.items())} AS a, {" + ".join(f"CASE WHEN {x} IS NOT NULL THEN {_NEAR[d]!r} ELSE 0 END" for d, x in _NEAR_SQL.items())} AS b FROM r WINDOW o AS (ORDER BY fpr, tpr))
    SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(CAST(a AS DOUBLE) / CAST(b AS DOUBLE), 6) AS smoothed FROM s""")
def roc_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ml.smooth_gaussian(ml.roc_points(_scored(spark, sf_dir), "score", "label"), "fpr", "tpr")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "smoothed")])


@query(f"WITH {_SCORED_SQL} SELECT label, predicted, count(*) AS count FROM scored GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.confusion(_scored(spark, sf_dir), "label", "predicted")


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT k.c AS label, count(*) FILTER (label = k.c AND predicted = k.c) AS tp, count(*) FILTER (label = k.c) AS support, count(*) FILTER (predicted = k.c) AS named FROM scored, (VALUES (0), (1)) AS k(c) GROUP BY 1),
    r AS (SELECT *, CASE WHEN named > 0 THEN CAST(tp AS DOUBLE) / named ELSE 0.0 END AS p, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS r FROM c)
    SELECT CAST(label AS INTEGER) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, support FROM r WHERE support > 0""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ml.class_report(_scored(spark, sf_dir), "label", "predicted")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_SCORED_SQL} SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.accuracy(_scored(spark, sf_dir), "label", "predicted").select(F.round("accuracy", 6).alias("accuracy"))


def _vectors(spark: SparkSession, sf_dir: str, dims: int = 64) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    xs = F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, dims)
    return e.select("vec_id", "label", (F.col("label") % 2).cast("double").alias("half"), array_to_vector(xs).alias("features"), *[xs[k].alias(f"x{k}") for k in range(dims)])


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.kmeans_labels(_vectors(spark, sf_dir), "label", 10).select("vec_id", "label", "cluster", "predicted")


@query()
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.silhouette(ml.kmeans_labels(_vectors(spark, sf_dir), "label", 2), "vec_id", "features", "cluster")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, CASE WHEN a.label = b.label THEN sum(list_distance(a.e, b.e)) / nullif(count(*) - 1, 0) ELSE avg(list_distance(a.e, b.e)) END AS m FROM v a, v b GROUP BY a.vec_id, a.label, b.label),
    s AS (SELECT vec_id, label, max(m) FILTER (label = other) AS a, min(m) FILTER (label <> other) AS b FROM d GROUP BY vec_id, label)
    SELECT vec_id, label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.euclidean_silhouette(_vectors(spark, sf_dir), "vec_id", "features", "label").select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


@query()
def svm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.decision_grid(_vectors(spark, sf_dir).select("x0", "x1", "half"), "x0", "x1", "half", 4.0)


@query()
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = ml.principal_components(_vectors(spark, sf_dir)).withColumn("c", vector_to_array("components"))
    return out.select("vec_id", F.col("c")[0].alias("c1"), F.col("c")[1].alias("c2"))


@query()
def svm_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.kernel_svm(_vectors(spark, sf_dir), "half", 64, 0.5).select("vec_id", "half", "prediction")


@query()
def logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return ml.probability(ml.logistic(rows, "half").transform(rows)).select("vec_id", "half", "prediction", "score")


@query()
def rfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = ml.eliminate_features(_vectors(spark, sf_dir).drop("features"), [f"x{k}" for k in range(64)], "half", 2, step=0.25)
    return spark.createDataFrame([(c,) for c in left], "feature string")


@query()
def dtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.decision_tree_accuracy(_vectors(spark, sf_dir).select("vec_id", "half", "features"), "vec_id", "half", seeds=5)


@query()
def mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    return ml.perceptron([64, 8, 10], "label", iterations=200).fit(rows).transform(rows).select("vec_id", "label", "prediction")


@query()
def relu_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    weights = learners.train_perceptron(rows, "vec_id", "label", [64, 8, 10], epochs=20, batch=5)
    return learners.apply_perceptron(rows.select("vec_id", "label", "features"), weights).select("vec_id", "label", "prediction")


@query()
def svm_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The support vectors of odd labels against even ones."""
    return learners.support_vectors(_vectors(spark, sf_dir).select("vec_id", "half", "features"), "vec_id", "half", 0.5).select(F.col("id").alias("vec_id"), "y", "alpha")


@query()
def kfold_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression

    rows = _vectors(spark, sf_dir).select("vec_id", "half", "features")
    return ml.cross_validate(rows, "vec_id", "half", LogisticRegression(labelCol="half", maxIter=100), 10)


@query()
def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components."""
    rows = _vectors(spark, sf_dir)
    model = ml.logistic(rows, "half")
    score = sum((F.col(f"x{k}") * float(w) for k, w in enumerate(model.coefficients)), F.lit(float(model.intercept)))
    return ml.permutation_importance(rows.drop("features"), "vec_id", [f"x{k}" for k in range(64)], score, "half")


@query(f"""WITH {POINT_SQL}, p AS (SELECT chain, vec_id, CAST(row_number() OVER (PARTITION BY chain ORDER BY md5(CAST(vec_id AS VARCHAR) || ':7'), vec_id) AS BIGINT) AS place FROM point) SELECT * FROM p WHERE place <= 10""")
def point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.ranked(point(spark, sf_dir), "vec_id", 7, ["chain"]).where("place <= 10").select("chain", "vec_id", "place")


@query(f"""WITH {RESIDUE_SQL}, v AS (SELECT event_id, state, leaf, value, md5(CAST(event_id AS VARCHAR) || ':0') AS d FROM residue WHERE value IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY d, event_id) AS k FROM v), n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM v GROUP BY state)), s AS (SELECT * FROM p, n WHERE k <= m)
    SELECT event_id, state, leaf, CAST(dense_rank() OVER (ORDER BY state) - 1 AS INTEGER) AS state_code, CAST(dense_rank() OVER (ORDER BY leaf) - 1 AS INTEGER) AS leaf_code,
      round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value, CASE WHEN row_number() OVER (ORDER BY d, event_id) <= round(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM s""")
def prepared_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.prepare(residue(spark, sf_dir).where("value IS NOT NULL"), "event_id", "state", ["value"], ["leaf"])
    return out.select("event_id", "state", "leaf", "state_code", "leaf_code", F.round("value", 6).alias("value"), "part")
