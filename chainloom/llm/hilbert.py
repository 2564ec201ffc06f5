"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2**bits`` cells, the cell is numbered along the
Hilbert curve, rows are sorted by that number, and the order is cut into runs.
A run is a compact region of every dimension, so a reader that filters on any of
them skips most shards by their minima and maxima.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank, rows_a_run, run_of, sortable

BITS, FILE_BYTES = 8, 128 << 20


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of integer points (Skilling 2004): ``cells`` is (points, dimensions)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the Gray code's inverse, from the coarsest cell
        low = q - 1
        for k in range(n):
            flip = (x[k] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    carry = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        carry = np.where(x[n - 1] & (1 << b), carry ^ ((1 << b) - 1), carry)
    x = [v ^ carry for v in x]
    index = np.zeros(len(cells), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            index = (index << 1) | ((x[k] >> b) & 1)
    return index


def category_cell(name: str, bits: int = BITS) -> Column:
    """A text dimension: equal values share a cell; null is a value of its own."""
    return F.pmod(F.crc32(F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).cast("binary")), F.lit(1 << bits))


def magnitude_cell(value: Column, bits: int = BITS) -> Column:
    """A size dimension on a logarithmic scale, 8 cells a doubling; null counts as zero."""
    cell = F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("double") + 1) * 8)
    return F.least(cell, F.lit((1 << bits) - 1))


def hilbert_order(df: DataFrame, dimensions: list[Column], bits: int = BITS, name: str = "curve") -> DataFrame:
    """Add ``name``: the position of each row's cell on the curve through all dimensions."""
    if not 0 < bits * len(dimensions) <= 62:
        raise ValueError("bits times dimensions must be between 1 and 62")

    @F.pandas_udf("long")
    def along(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy(dtype=np.int64) for c in cells]), bits))

    return df.withColumn(name, along(*[d.cast("long") for d in dimensions]))


def cut_runs(df: DataFrame, order: list[str], n_shards: int) -> DataFrame:
    """Add shard (0 to ``n_shards`` - 1) and slot: runs of the order whose lengths differ by one at most.

    Three columns of the sorted rows are shuffled once; the number of rows is
    known from the partitions' lengths.
    """
    ranked = global_rank(df, order, "_rank")
    rows = ranked.agg(F.count(F.lit(1)).alias("_rows"))
    long, cut = F.expr(f"_rows % {n_shards}"), F.expr(f"_rows div {n_shards}")
    ranked = ranked.join(F.broadcast(rows)).withColumn("_long", long).withColumn("_cut", cut)
    head = F.col("_long") * (F.col("_cut") + 1)  # the first shards have one row more
    early = F.col("_rank") < head
    shard = F.when(early, F.expr("_rank div (_cut + 1)")).otherwise(F.col("_long") + F.expr("(_rank - _long * (_cut + 1)) div greatest(_cut, 1)"))
    slot = F.when(early, F.expr("_rank % (_cut + 1)")).otherwise(F.expr("(_rank - _long * (_cut + 1)) % greatest(_cut, 1)"))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("_rank", "_rows", "_long", "_cut")


def _placed(documents: DataFrame, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        *keep, (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        category_cell("source").alias("_a"), category_cell("lang").alias("_b"), magnitude_cell(F.octet_length(text)).alias("_c"),
    )
    return hilbert_order(rows, [F.col("_a"), F.col("_b"), F.col("_c")], name="_curve").drop("_a", "_b", "_c")


def shard_documents(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve, for every row.

    Dimensions: source, lang and UTF-8 length.  Law ``rows``: shards differ by one
    row at most.  A null text has size 1 and the checksum of the empty text; null
    source or lang is a value of its own; rows with equal curve positions are
    ordered by checksum and doc_id, so that copies lie together.  With fewer rows
    than shards the last shards are empty.  Other columns are not read.
    """
    placed = _placed(documents, ["doc_id"]).select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_curve").alias("curve"))
    cut = cut_runs(placed, ["curve", "text_crc32", "doc_id", "size"], n_shards)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(documents: DataFrame, path: str, columns: list[str], n_shards: int = 8, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all rows and columns of ``documents`` by shard and return the zone map: the minimum and maximum of ``columns`` in each shard.

    The order is that of ``shard_documents``.  Each shard's rows are cut into files of
    about ``file_bytes`` of text, each written by one task, so a shard is never one
    task.  Rows without doc_id and rows that repeat one are kept as they are; only rows
    equal in doc_id, text and curve position always share a file, which may move a
    shard's border by their number.  An empty table gives an empty zone map.
    """
    key = F.concat(sortable(F.col("_curve")), sortable(F.col("_crc")), sortable(F.col("doc_id")), sortable(F.col("_size")))
    full = _placed(documents, documents.columns).withColumn("_key", key)
    rows, size = full.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(1))).first()
    per = rows_a_run(rows, size, file_bytes)
    cut = cut_runs(full.select("_key"), ["_key"], n_shards).where((F.col("slot") % per == 0) & ((F.col("slot") > 0) | (F.col("shard") > 0)))
    cuts = cut.groupBy("_key").agg(F.max("shard").alias("shard")).toArrow().sort_by("_key")  # a row a file
    shards = np.concatenate(([0], cuts.column("shard").to_numpy())).astype(np.int32)
    full = full.withColumn("_run", run_of(F.col("_key"), np.array(cuts.column("_key").to_pylist(), dtype=bytes)))

    @F.pandas_udf("int")
    def shard_of(run: pd.Series) -> pd.Series:
        return pd.Series(shards[run.to_numpy()])

    full = full.withColumn("shard", shard_of("_run"))
    ordered = full.repartition("_run").sortWithinPartitions("shard", "_run", "_key").select(*documents.columns, "shard")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)
    kept = documents.sparkSession.read.schema(ordered.schema).parquet(path)
    return kept.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])
