"""Vector code compression: product quantisation in integers, entries found by exponion search.

A vector's components become integers and are cut into equal parts; each part
position has a codebook of a few entries.  To find a part's nearest entry the search
starts at the entry it had before, at squared distance ``u``: an entry as near as that
lies within twice the distance of the start (Newling, Fleuret 2016), so only the
start's neighbours with squared distance up to ``4 u``, a prefix of its sorted list,
are looked at.  Distances are exact integers; ties go to the lower index.

Scale: a pass over the vectors for each assignment, no shuffle of vectors.  A task
that assigns also adds up its vectors by entry and leaves one row of sums, a fixed
size; the sums meet in a grouped sum over as many keys as the codebooks have numbers,
and those come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BROADCAST_LABELS = 1_000_000


class Codebook:
    """The entries of one part position, and each entry's others by distance, then index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        order = np.argsort(gap, axis=1, kind="stable")
        self.near = np.array([np.append(a, row[row != a]) for a, row in enumerate(order)])  # itself first among equals
        self.gaps = np.take_along_axis(gap, self.near, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry."""
        best, least = start.copy(), ((x - self.entries[start]) ** 2).sum(axis=1)
        reach = np.zeros(len(x), dtype=np.int64)
        order = np.argsort(start, kind="stable")
        borders = np.searchsorted(start[order], np.arange(len(self.entries) + 1))
        for a in np.flatnonzero(np.diff(borders)):
            rows = order[borders[a] : borders[a + 1]]
            reach[rows] = np.searchsorted(self.gaps[a], 4 * least[rows], side="right")
        far = np.argsort(-reach, kind="stable")
        depth = -reach[far]
        for k in range(1, int(reach.max(initial=0))):
            rows = far[: np.searchsorted(depth, -k)]  # those with more than k neighbours in reach
            other = self.near[start[rows], k]
            gap = ((x[rows] - self.entries[other]) ** 2).sum(axis=1)
            better = (gap < least[rows]) | ((gap == least[rows]) & (other < best[rows]))
            rows = rows[better]
            best[rows], least[rows] = other[better], gap[better]
        return best, least


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("q")
    return lists.flatten().to_numpy().reshape(batch.num_rows, -1)


def _assign(books: list[Codebook], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integers, codes and squared distances of a batch, by row and part."""
    x = _matrix(batch)
    parts = len(books)
    width = x.shape[1] // parts
    if batch.schema.get_field_index("code") < 0:
        start = np.zeros((len(x), parts), dtype=np.int64)
    else:
        start = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
    codes, gaps = np.zeros((len(x), parts), dtype=np.int64), np.zeros((len(x), parts), dtype=np.int64)
    for p, book in enumerate(books):
        codes[:, p], gaps[:, p] = book.nearest(x[:, p * width : (p + 1) * width], start[:, p])
    return x, codes, gaps


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _round(books: list[np.ndarray], carried: list[str], types: list[pa.DataType]):
    """Assigns and carries rows on; the last row of a task has the sums and counts by part, entry and place."""
    parts, (entries, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, search = np.zeros((parts, entries, width + 1), dtype=np.int64), [Codebook(b) for b in books]
        names = [*carried, "code", "sums"]
        for batch in _chunks(batches):
            x, codes, _ = _assign(search, batch)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], np.column_stack((x[:, p * width : (p + 1) * width], np.ones(len(x), dtype=np.int64))))
            raw = codes.astype(np.uint8).tobytes()
            packed = pa.array([raw[a : a + parts] for a in range(0, len(raw), parts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], packed, pa.nulls(len(x), pa.list_(pa.int64()))], names)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], pa.nulls(1, pa.binary()), pa.array([sums.reshape(-1).tolist()], pa.list_(pa.int64()))], names)

    return run


def integer_vectors(embeddings: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``q``, the components as floor(scale * x); malformed rows are left out.

    Malformed are null vectors, those with null or non-finite components, those whose
    length is zero or no multiple of ``parts``, and those of another length than the row
    with the least vec_id.  Components stop at a limit where squared distances still fit
    64 bits (2^27 for 64 of them).
    """
    x = F.col("embedding")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.where(x.isNotNull()).where(whole & (F.size(x) > 0) & (F.size(x) % parts == 0))
    first = rows.select("vec_id", F.size(x).alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").first()
    size = first.n if first else parts
    limit = float(1 << ((61 - int(np.ceil(np.log2(size)))) // 2))
    bound = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(limit)), F.lit(-limit))).cast("long")
    label = F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int").alias("label")
    return rows.where(F.size(x) == size).select("vec_id", label, F.transform(x, bound).alias("q"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame]:
    """The codebooks after ``rounds`` rounds, and the vectors with the codes of the last round's assignment.

    A codebook starts as that part of the rows with the least vec_ids (nulls last; equal
    ones by their components).  A round assigns every vector, then replaces each used
    entry by the floor of its mean.  With fewer vectors than entries there are as many
    entries as vectors.
    """
    start = vectors.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    first = np.array([r.q for r in start], dtype=np.int64)
    width = first.shape[1] // parts
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    carried = ["vec_id", "label", "q"]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(vectors.schema[c].dataType) for c in carried]
    schema = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in carried) + ", code binary, sums array<long>"
    table = vectors
    for _ in range(rounds):
        done = materialise(table.mapInArrow(_round(books, carried, types), schema), "codes")
        total = done.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        sums = np.zeros(parts * len(first) * (width + 1), dtype=object)
        for r in total.collect():  # as many rows as the codebooks have numbers
            sums[r["at"]] = int(r.v)
        for p, each in enumerate(sums.reshape(parts, len(first), width + 1)):
            used = each[:, -1] > 0
            books[p][used] = (each[used, :-1] // each[used, -1:]).astype(np.int64)
        table = done.where("code IS NOT NULL").drop("sums")
    return books, table


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, ``code`` (two hex digits a part) and ``error`` (squared distance) with given codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in _chunks(batches):
            _, codes, gaps = _assign(search, batch)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([text[a : a + step] for a in range(0, len(text), step)], pa.string()), pa.array(gaps.sum(axis=1))], ["vec_id", "label", "code", "error"]
            )

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return vectors.mapInArrow(run, f"{kinds}, code string, error long")


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books[p][i] for p, i in enumerate(bytes.fromhex(code))])


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every well-formed vector (see ``integer_vectors``).

    Rows that repeat a vec_id, or have none, are coded each by itself.  Null labels
    count as equal.  Without a well-formed vector the result is empty.
    """
    vectors = materialise(integer_vectors(embeddings, parts), "vectors")
    if not vectors.limit(1).count():
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    books, table = train(vectors, parts, entries, rounds)
    coded = materialise(encode(table, books), "coded")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_LABELS else totals.hint("merge")
    out = coded.join(totals, coded["label"].eqNullSafe(totals["label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
