"""Orders over a whole table without a single-task window: ranks, cuts by rank, the most frequent rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise

MOST_RUNS = 1 << 16  # runs of an order cut by rank; bounds the keys that reach the driver to some megabytes
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Add ``name``: the 0-based position of each row in the order given.

    One range shuffle sorts the rows; each partition's length is counted, and
    only those lengths (one row a partition) meet in one task and are broadcast.
    Ties must be broken by ``order`` for reruns to agree.  An empty input gives
    an empty output.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    kept = materialise(spread.withColumn("_mid", F.monotonically_increasing_id()), "rank")
    part, row = F.shiftright("_mid", _ROW_BITS), F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    lengths = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        kept.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row)
        .drop("_part", "_before", "_mid")
    )


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, at most ``limit`` of them; of the last level of counts all rows or none.

    Counts are levelled (exactly up to 64, then by sixteenths of a doubling), the
    levels' sizes, some thousand rows, give the cut, and the rows pass a filter, so no
    task sorts them.
    """
    level = F.when(F.col(count) <= 64, F.col(count)).otherwise(F.floor(F.log2(count) * 16) - 32).cast("long")
    sizes = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    cut, held = None, 0
    for at, rows in sorted(((r.level, r.rows) for r in sizes), reverse=True):
        held += rows
        if held > limit:
            break
        cut = at
    return df.where(level >= cut) if cut is not None else df.limit(0)


def sortable(number: Column) -> Column:
    """A long as text of fixed length that sorts like the number, nulls first."""
    digits = F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.when(number.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), digits))


def rows_a_run(rows: int, size: int, bytes_: int) -> int:
    """Rows that hold about ``bytes_`` of ``size``, or more where that would make over ``MOST_RUNS`` runs."""
    return max(1, rows * bytes_ // max(size, 1), -(-rows // MOST_RUNS))


def cut_keys(keys: DataFrame, per: int) -> np.ndarray:
    """The keys (column ``key``, ASCII text) at every ``per``-th place of their order: one for each run but the first.

    They depend on the keys alone, never on partitions or samples.  With ``per`` from
    ``rows_a_run`` fewer than ``MOST_RUNS`` keys reach the driver, at any size.
    """
    ranked = global_rank(keys.select("key"), ["key"])
    cuts = ranked.where((F.col("rank") > 0) & (F.col("rank") % per == 0)).select("key").distinct().toArrow()
    return np.sort(np.array(cuts.column("key").to_pylist(), dtype=bytes))


def run_of(key: Column, cuts: np.ndarray) -> Column:
    """The number of the run that a key belongs to; equal keys share a run."""

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy().astype(bytes), side="right").astype(np.int32))

    return find(key) if len(cuts) else F.lit(0)
