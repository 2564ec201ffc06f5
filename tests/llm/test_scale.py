"""What reaches the driver is bounded, a hot node's rows are split, and a manifest is never missing."""

import public_tokenizers
from pyspark.sql import functions as F

from chainloom.llm import components, dac, decontam, neardup, ranking
from chainloom.llm.workspace import fresh_dir, materialise, publish

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_runs_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 7)) for k in range(500)], "doc_id long, text string")
    want = sorted(map(tuple, dac.token_ids(docs, BPE).collect()))
    monkeypatch.setattr(ranking, "MOST_RUNS", 3)
    manifest = dac.write_token_files(docs, BPE, file_bytes=100)
    assert manifest.select("shard").distinct().count() == 3
    assert sorted(map(tuple, dac.read_token_files(manifest).collect())) == want
    assert ranking.rows_a_run(10**13, 10**17, 8 << 20) * 3 >= 10**13 and ranking.rows_a_run(0, 1, 8) == 1


def test_hot_node_is_split(spark):
    """The join back to the least neighbour is split by adaptive execution where one node has nearly all links."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        links = spark.range(1, 60_000, numPartitions=8).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        for star, hub in ((components._large_star, "a"), (components._small_star, "b")):
            edges = links if hub == "a" else links.select(F.col("b").alias("a"), F.lit(60_000).cast("long").alias("b"))
            out = star(edges)
            assert out.count() and out.where("a <> b").count()
            rows = out.selectExpr("sum(a)", "sum(b)")
            rows.collect()
            assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString(), hub
        found = components.connected_components(links)
        assert found.where("component = 0").count() == found.count() == 60_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_publish_replaces(spark):
    folder = fresh_dir(spark, "published")
    for n in (3, 5):
        assert publish(spark.range(n), folder, "manifest").count() == n
    listed = [s.getPath().getName() for s in spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
    assert listed == ["manifest"]


def test_small_tables_have_few_files(spark, monkeypatch):
    """What near-duplicates keep of many tasks' rows is a file or two, and the rows are the same."""
    merged = {}

    def note(df, label, **how):
        out = materialise(df, label, **how)
        merged[label] = how.get("merge", False), len(out.inputFiles())
        return out

    monkeypatch.setattr(neardup, "materialise", note)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        texts = [" ".join(f"w{(k // 2 * 97 + j) % 5000}" for j in range(40 + k % 2)) for k in range(400)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
        found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
        assert found == {k: k // 2 * 2 for k in range(400)}
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
        many = spark.range(40_000, numPartitions=24)
        assert len(materialise(many, "many").inputFiles()) == 24 and len(materialise(many, "few", merge=True).inputFiles()) < 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert all(merged[x][0] and merged[x][1] <= 2 for x in ("buckets", "shared", "star", "extra")), merged


def test_windows_are_not_broadcast(spark, monkeypatch):
    """Windows hold lists, which Spark sizes as one number; their join is a shuffle even where it thinks them small."""
    plans, write = {}, decontam.materialise

    def spy(df, label, **kinds):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, **kinds)

    monkeypatch.setattr(decontam, "materialise", spy)
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"some words {text} and more"), (2, "other words altogether " * 9)], "doc_id long, text string")
    found = decontam.leaks(docs, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in found] == [(1, 7, 2, 1.0)]
    assert "SortMergeJoin [tag#" in plans["best"] and "BroadcastHashJoin [tag#" not in plans["best"]
