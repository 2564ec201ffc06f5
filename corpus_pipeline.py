"""A corpus pipeline of five stages over ``documents``; each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.llm import dac, decontam, mixing, neardup, toxicity
from chainloom.llm.queries import tokenizer_path
from chainloom.llm.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``dropped`` (column ``key``); the key is never null.

    The keys are written and counted first: up to ``BROADCAST_IDS`` of them are
    broadcast, so that texts are not shuffled; more are joined by a shuffle.
    """
    keys = materialise(dropped.select("key").distinct(), "dropped")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys.hint("merge")
    return docs.select(*COLUMNS, key.alias("key")).join(keys, "key", "left_anti").select(*COLUMNS)


def _text() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go, by their text: rows without doc_id too, and every copy of a rejected text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = materialise(toxicity.toxicity_scores(docs.select("doc_id", "text", _text().alias("key")), labels, keep=("key",)), "toxic")
    return _without(docs, scores.where("predicted = 1"), _text())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the least doc_id: five words a shingle, similarity 0.8 or more.

    Rows are known by a hash of doc_id and text, so rows without doc_id and different
    texts of one doc_id count by themselves; of rows equal in both one stays, unless
    they have no words.  Rows without words all stay.
    """
    row = F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))
    groups = neardup.near_duplicates(docs.select(row.alias("doc_id"), "text"), width=5, threshold=0.8, bands=40)
    groups = materialise(groups.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")), "groups")
    named = groups.distinct().join(docs.select(row.alias("key"), "doc_id").distinct(), "key")
    best = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "key"))["key"].alias("key"))
    out = _without(docs, named.select("key").join(best.select("key").hint("merge"), "key", "left_anti"), row)
    twice = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    if twice.limit(1).count():
        marked = out.withColumn("key", row)
        twice = materialise(twice, "twice")
        once = marked.join(twice.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
        out = marked.join(twice.hint("merge"), "key", "left_anti").unionByName(once).select(*COLUMNS)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go, by their text: rows without doc_id too."""
    found = decontam.leaks(docs.select(_text().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, materialise(found.select(F.col("doc_id").alias("key")), "leaks"), _text())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix takes it: whole passes, and once more if half of its words are taken again.

    Rows are known by a hash of all their columns, so rows without doc_id and
    different rows of one doc_id count by themselves; equal rows share their copies.
    """
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS], *[F.col(c).isNull() for c in COLUMNS])
    docs = docs.select(*COLUMNS, key.alias("key"))
    times = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    times = mixing.mix(docs, keep=("key",)).groupBy("key").agg(F.sum(times).alias("times"), F.count(F.lit(1)).alias("rows"))
    times = materialise(times, "times").where("times > 0")  # a row for most documents, so never broadcast
    chosen = docs.join(times.hint("merge"), "key").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    own = F.expr("CAST(times div rows + IF(place <= times % rows, 1, 0) AS INT)")
    return chosen.withColumn("own", own).where("own > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "own"))).select(*COLUMNS)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return dac.token_ids(docs, tokenizer_path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_ids", write_token_ids),
]

#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
