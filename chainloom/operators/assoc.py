"""Association statistics of items that occur together: log-likelihoods of sets and of pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def permutation_factor(items: Column, size: int, compat: bool = False) -> Column:
    """Number of orders of a multiset: size! over the product of the multiplicities' factorials.

    ``compat`` keeps an older reading for four items, in which two pairs count 4, not 6.
    """
    distinct = F.array_distinct(items)
    fact = F.create_map(*[F.lit(x) for n in range(size + 1) for x in (n, math.factorial(n))])
    ways = F.aggregate(distinct, F.lit(1), lambda t, x: t * F.element_at(fact, F.size(F.filter(items, lambda y: y == x))))
    factor = (F.lit(math.factorial(size)) / ways).cast("int")
    return F.when((F.size(distinct) == 2) & (factor == 6), 4).otherwise(factor) if compat and size == 4 else factor


def canonical_key(items: list[Column]) -> tuple[Column, Column]:
    """The items in order, and their concatenation: one key for all orders of a set."""
    ordered = F.array_sort(F.array(*items))
    return ordered, F.array_join(ordered, "")


def item_frequencies(df: DataFrame, items: str) -> DataFrame:
    """item, count and frequency over all places of the array column ``items``."""
    counts = df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("item", "count", (F.col("count") / F.col("_total")).alias("frequency"))


def set_log_likelihood(df: DataFrame, items: str, size: int = 4, metrics: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """log10 of a set's frequency over what its items' frequencies give for all its orders.

    One aggregate counts the sets, with the means of ``metrics``; the items' counts
    come from those counted sets, which are kept, so the input is read once for both.  The
    item table has one row for each distinct item; Spark broadcasts it if it is small.
    """
    counted = df.groupBy(items).agg(F.count(F.lit(1)).alias("count"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])
    counted = counted.persist()  # read once for the sets and again for their items; one row a distinct set
    places = counted.select(F.explode(items).alias("item"), "count").groupBy("item").agg(F.sum("count").alias("n"))
    whole = places.agg(F.sum("n").alias("_places"))
    rows = counted.crossJoin(F.broadcast(whole)).withColumn("frequency", F.col("count") * size / F.col("_places"))
    chance = None
    for k in range(size):
        one = places.select(F.col("item").alias(f"_i{k}"), F.col("n").alias(f"_n{k}"))
        rows = rows.join(one, rows[items][k] == one[f"_i{k}"])
        p = F.col(f"_n{k}") / F.col("_places")
        chance = p if chance is None else chance * p
    rows = rows.withColumn("llh", F.log10(F.col("frequency") / (permutation_factor(F.col(items), size, compat) * chance)))
    return rows.select(items, "llh", "frequency", "count", *[f"avg_{m}" for m in metrics])


def pairs_of(values: list[Column]) -> Column:
    """All pairs (i < j) of the values, numbered in order."""
    at = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values))]
    return F.array(*[F.struct(F.lit(n).alias("n"), values[i].alias("a"), values[j].alias("b")) for n, (i, j) in enumerate(at)])


def distinct_edges(df: DataFrame, part: list[str], first: str, second: str, order: list[str]) -> DataFrame:
    """Keep the first row in ``order`` of each (part, first, second)."""
    w = Window.partitionBy(*part, first, second).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def pair_log_likelihood(df: DataFrame, a: str, b: str, length: str) -> DataFrame:
    """edge, llh, frequency, count and mean length of undirected pairs."""
    df = df.withColumn("_items", F.array_sort(F.array(a, b))).withColumnRenamed(length, "length")
    out = set_log_likelihood(df, "_items", 2, ("length",))
    return out.select(F.array_join("_items", "").alias("edge"), "llh", "frequency", "count", F.col("avg_length").alias("average_length"))


def identical_in_top(ranked: DataFrame, edge: Column, identical: Column, order: list[Column], tops: tuple[int, ...]) -> DataFrame:
    """How many of the best n pairs join an item with itself; only the largest n rows are ranked."""
    best = ranked.withColumn("_same", identical).orderBy(*order).limit(max(tops))
    rank = best.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    wanted = F.explode(F.array(*[F.lit(n) for n in tops]))
    return rank.select("_rank", "_same", wanted.alias("top")).groupBy("top").agg(F.count_if(F.col("_same") & (F.col("_rank") <= F.col("top"))).alias("identical"))
