"""Exact dedup by deterministic block naming.

Each text is cut into blocks of ``block_bytes`` bytes.  All distinct blocks are
sorted by (64-bit hash, bytes) and named by their rank; then adjacent names are
paired and the distinct pairs named by rank, over and over, until each text has
one name.  Two texts have the same number of blocks and the same name if and
only if their bytes are equal: hash ties are told apart by the bytes, so the
names are free of collisions.

Scale: block contents are shuffled once, after each Arrow batch has dropped its
own repeats and each task has combined those of its batches, so a block that a
third of all rows hold arrives once a task.
Everything after that moves rows of a few integers.  The rounds number
log2(blocks of the longest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_rank
from .textkernel import slices, span_hashes, texts_of
from .workspace import map_texts, materialise

BLOCK_BYTES = 16384


def _cut(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and positions of the blocks, and the number of blocks of each row; an empty text has one."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // size))
    row = np.repeat(np.arange(len(lengths)), count)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[row] + pos * size
    return starts, np.minimum(starts + size, offsets[row + 1]), row, pos, count


def _contents(block_bytes: int, hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            seen: dict[tuple[int, bytes], None] = {}
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, *_ = _cut(at, block_bytes)
                h = (span_hashes(part, starts, ends) >> np.uint64(64 - hash_bits)).view(np.int64)
                raw = memoryview(part)
                for k, s, e in zip(h.tolist(), starts.tolist(), ends.tolist()):
                    seen.setdefault((k, bytes(raw[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int64()), pa.array([x for _, x in seen], pa.binary())], ["h", "block"])

    return run


def _places(block_bytes: int, hash_bits: int, with_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            ids, sha = batch.column("doc_id"), batch.column("text_sha256")
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, row, pos, count = _cut(at, block_bytes)
                h = (span_hashes(part, starts, ends) >> np.uint64(64 - hash_bits)).view(np.int64)
                tag = span_hashes(part, at[:-1], at[1:], salt=1).view(np.int64)
                pick = pa.array(row)
                cols = [
                    ids.slice(a, b - a).take(pick), sha.slice(a, b - a).take(pick), pa.array(tag[row]),
                    pa.array(count[row], pa.int64()), pa.array(pos, pa.int64()), pa.array(h),
                ]
                names = ["doc_id", "text_sha256", "tag", "n_blocks", "pos", "h"]
                if with_block:
                    raw = part.tobytes()
                    cols.append(pa.array([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary()))
                    names.append("block")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _name_blocks(docs: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """(doc_id, text_sha256, tag, n_blocks, pos, name) for each block of each row."""
    distinct = (
        map_texts(docs.select("text"), _contents(block_bytes, hash_bits), "h long, block binary")
        .groupBy("h", "block").agg(F.count(F.lit(1)).alias("_n"))
    )
    same = Window.partitionBy("h")
    ties = materialise(
        distinct.withColumn("m", F.count(F.lit(1)).over(same)).withColumn("ord", F.row_number().over(same.orderBy("block")))
        .select("h", "ord", F.when(F.col("m") > 1, F.col("block")).alias("block")), "blocks",
    )
    names = global_rank(ties, ["h", "ord"], "name")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_sha256 string, tag long, n_blocks long, pos long, h long"
    placed = map_texts(docs, _places(block_bytes, hash_bits, False), schema)
    tied = names.where("block IS NOT NULL")
    named = placed.join(names.where("block IS NULL").select("h", "name"), "h").drop("h")
    if tied.limit(1).count():  # blocks whose hashes clash are told apart by their bytes
        full = map_texts(docs, _places(block_bytes, hash_bits, True), schema + ", block binary")
        named = named.unionByName(full.join(tied.select("h", "block", "name"), ["h", "block"]).drop("h", "block"))
    return named


def name_documents(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row for each row of ``documents``: doc_id, text_sha256, n_blocks, name.

    A null text counts as empty, which is one empty block.  Rows with a null
    doc_id are named like others.  Other columns, whatever their names, are not
    read.  An empty table gives an empty result.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    blocks = materialise(_name_blocks(docs, block_bytes, hash_bits), "named")
    key = ["doc_id", "tag", "n_blocks"]
    done = blocks.where("n_blocks = 1").select(*key, "name").distinct()
    level = blocks.where("n_blocks > 1").select(*key, F.col("pos").alias("i"), "name").distinct()
    longest = blocks.agg(F.max("n_blocks")).first()[0] or 1
    while longest > 1:
        odd = F.col("i").bitwiseAND(1) == 1
        pairs = materialise(
            level.groupBy(*key, F.shiftright("i", 1).alias("i"))
            .agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b")), "pairs",
        )
        names = global_rank(pairs.select("a", "b").distinct(), ["a", "b"], "name")
        level = materialise(pairs.join(names, ["a", "b"]).drop("a", "b"), "level")
        longest = (longest + 1) // 2
    done = done.unionByName(level.where("i = 0").drop("i"))
    rows = blocks.where("pos = 0").select("doc_id", "text_sha256", "tag", "n_blocks")
    same = (rows["doc_id"].eqNullSafe(done["doc_id"])) & (rows["tag"] == done["tag"]) & (rows["n_blocks"] == done["n_blocks"])
    return rows.join(done, same).select(rows["doc_id"], "text_sha256", rows["n_blocks"], "name")


def exact_duplicates(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``documents``.

    The largest doc_id of equal texts stays; rows that repeat it all say kept.
    A row without doc_id stays only if no row of its group has one.
    """
    named = materialise(name_documents(documents, block_bytes, hash_bits), "names")
    groups = named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "groups")  # so that the join below is one whose hot partitions Spark can split
    return named.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
