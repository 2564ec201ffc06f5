"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

The mix has as many words as the corpus.  Each source's share follows its weight
but stops at ``most`` times its size, and the excess is shared again by weight.
Blocks of ``block`` words are then given to sources by highest quotients
target / (2k - 1), for a growing number of blocks: the method never takes a block
back when the number grows, so differences are integer quotas for each shard.
Last, each source's documents are put in a seeded order, over and over, and cut into
blocks of the running word count; each shard takes as many blocks as its quota says,
from where the shard before it ended.

Scale: no row stands for a block.  A source's quota lies within half the number
of sources of its exact share, so only about three candidate seats a source are
ranked.  The running word count of a source comes from ``2**12`` hash buckets a
source, so no task holds a source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise

BLOCK, MOST, WEIGHTS, SEED, SHARDS, PREFIX = 32, 3, (5, 2, 1), "mix-1", 8, 3


def word_count(text: Column) -> Column:
    """Words of a text: runs outside space and 0x09-0x0D; null has none.

    Each run becomes one character and those are counted: ``regexp_count`` lists all words of a text first.
    """
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.coalesce(F.length(F.regexp_replace(bare, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")), F.lit(0)).cast("long")


def sized(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return documents.select("doc_id", *keep, F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight and target, one row a source; null is a source and comes last.

    Sources are full when ``most * size / weight`` is at most the level at which
    the others share what the full ones leave.  The table has a row for each
    source, so its windows are small.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, all_ = fill.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    table = table.withColumn("total", F.sum("source_size").over(all_)).withColumn(
        "rest_w", F.sum("weight").over(all_) - F.sum("weight").over(upto) + F.col("weight")
    ).withColumn("left", F.col("total") - F.sum("cap").over(upto) + F.col("cap"))
    # in this order a source is full while its cap, in units of weight, is no more than the level left for it and those after it
    level = F.col("left").cast("double") / F.col("rest_w")
    full = F.col("cap") * F.col("rest_w") <= F.col("left") * F.col("weight")
    table = table.withColumn("level", F.min(F.when(~full, F.struct(F.col("rest_w") * -1, level.alias("x")))).over(all_)["x"])
    share = F.when(full, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return table.select("source", "source_size", "weight", "cap", share.alias("target"), "total")


def quotas(table: DataFrame, blocks: Column, n: str = "blocks") -> DataFrame:
    """Seats of each source when ``blocks`` are given by highest quotients target / (2k - 1)."""
    all_ = Window.partitionBy()
    sources, whole = F.count(F.lit(1)).over(all_), F.sum("target").over(all_)
    table = table.withColumn("m", blocks).withColumn("k", sources).withColumn("whole", whole)
    near = F.when(F.col("whole") > 0, F.col("target") / F.col("whole")).otherwise(0.0)
    low = F.greatest(F.floor(near * (F.col("m") - F.col("k") / 2)) - 1, F.lit(0))
    high = F.ceil(near * (F.col("m") + F.col("k") / 2)) + 1
    seats = table.withColumn("low", low).withColumn("seat", F.explode(F.sequence(F.col("low") + 1, F.greatest(high, F.col("low") + 1))))
    rank = F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("seat") - 1)).desc(), F.col("source").asc_nulls_last(), "seat"))
    open_ = F.col("m") - F.sum(F.when(F.col("seat") == F.col("low") + 1, F.col("low")).otherwise(0)).over(all_)
    won = seats.withColumn("won", (rank <= open_) & (F.col("target") > 0))
    return won.groupBy("source").agg((F.max("low") + F.sum(F.col("won").cast("long"))).alias(n))


def shard_quotas(table: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """source, shard, upto, blocks: each shard's integer quota of blocks from each source, and those of all shards up to it."""
    total = F.floor(F.col("total") / block + 0.5)
    out = None
    for s in range(shards):
        upto = quotas(table, F.floor(total * (s + 1) / shards), "upto").withColumn("shard", F.lit(s))
        out = upto if out is None else out.unionByName(upto)
    before = F.lag("upto", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return out.select("source", "shard", "upto", (F.col("upto") - before).alias("blocks"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = SEED, keep: tuple[str, ...] = (), shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and shares (the words that each shard takes, together ``taken``) for every row.

    A null text has size 0 and nothing is taken from it; null sources form one
    source, the last.  The seeded order is by a digest of doc_id, so reruns agree;
    rows that repeat a doc_id are told apart by their size, and rows equal in both
    stand side by side in either order with the same sums.  Each source's taken
    words are within a block of its target.  Other columns are not read but for those
    named in ``keep``, which come last and order rows equal in doc_id and size.
    """
    docs = sized(documents, keep)
    table = materialise(targets(docs, weights, most), "targets")  # a row a source, read for each shard
    quota = shard_quotas(table, shards, block).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("q"))  # a row a source
    plan = table.join(quota, table["source"].eqNullSafe(quota["source"])).drop(quota["source"])
    ends = F.transform("q", lambda x: F.least(x["upto"] * block, F.col("cap")))  # where each shard's blocks end, in words
    plan = plan.select("source", "source_size", "target", ends.alias("ends"))
    docs = docs.withColumn("digest", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))).withColumn("bucket", F.substring("digest", 1, PREFIX))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    docs = docs.join(sums, docs["source"].eqNullSafe(sums["source"]) & (docs["bucket"] == sums["bucket"])).drop(sums["source"], sums["bucket"])
    docs = docs.join(plan, docs["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    start = F.col("before") + F.col("inside")
    docs = docs.withColumn("start", start)
    # a document's words among the first so many of its source: once a whole pass, and what the last pass has reached
    upto = "transform(ends, e -> if(source_size > 0, (e div source_size) * size + greatest(least(start + size, e % source_size) - start, 0L), 0L))"
    docs = docs.withColumn("upto", F.expr(upto)).withColumn("shares", F.transform("upto", lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get("upto", i - 1))))
    taken = F.aggregate("shares", F.lit(0).cast("long"), lambda t, x: t + x)
    return docs.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shares", *keep)
