"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast table with the lengths of the most frequent
pre-tokens (``TABLE`` of them at most, 12 bytes each); the second is a bounded cache
in each Python worker, which encodes what the table lacks.  No pre-token is
shuffled: only each partition's bounded summary of frequent ones is merged, to
fill the table, and the table changes speed alone, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import most_frequent
from .textkernel import HashTable, slices, span_pairs, texts_of
from .units import UnitCache, piece_units
from .workspace import map_texts, materialise

TABLE, SUMMARY, LIMIT = 1 << 16, 1 << 13, 4096


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model puts a space before each text; so do we, before it is cut into units."""
    return np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))


@lru_cache(maxsize=2)
def _piece_model(path: str) -> UnitCache:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    sign = "▁"
    if any(sign in model.id_to_piece(i).lstrip(sign) for i in range(model.get_piece_size())):
        raise ValueError("this model has pieces with white space inside; its texts can't be cut into units")
    alone = len(model.encode("a ")) - len(model.encode("a"))

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode([u[1:].decode() for u in units], num_threads=1)  # the model adds the first space itself
        sizes = np.array([alone if u == b" " else len(x) for u, x in zip(units, found)], dtype=np.int32)
        return np.zeros(0, dtype=np.int32), sizes

    return UnitCache(encode)


def _units(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    part, at = _spaced(part, at)
    starts = piece_units(part, at)
    ends = np.append(starts[1:], len(part)).astype(np.int64)
    return part, at, starts, ends, *span_pairs(part, starts, ends)


def _summary(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in slices(offsets):
                part, _, starts, ends, h, _ = _units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                unique, where, count = np.unique(h, return_index=True, return_counts=True)
                top = np.argsort(-count, kind="stable")[:keep]
                raw = part.tobytes()
                for k, s, e, c in zip(unique[top].tolist(), starts[where[top]].tolist(), ends[where[top]].tolist(), count[top].tolist()):
                    if k in seen:
                        seen[k][1] += c
                    else:
                        seen[k] = [raw[s:e], c]
                if len(seen) > 8 * keep:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1][1])[:keep])
        best = sorted(seen.values(), key=lambda x: -x[1])[:keep]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in best], pa.binary()), pa.array([c for _, c in best], pa.int64())], ["unit", "n"])

    return run


def _frequent(texts: DataFrame, model: str, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and the lengths of at most ``table`` frequent pre-tokens."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _piece_model(model)
        for batch in batches:
            data, offsets = texts_of(batch.column("unit"))
            h, check = span_pairs(data, offsets[:-1], offsets[1:])
            _, size = cache.look_up(h, check, data.tobytes(), offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), pa.array(size, pa.int32())], ["h", "check", "n"])

    merged = map_texts(texts, _summary(SUMMARY), "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    best = most_frequent(materialise(merged, "units"), "n", table).select("unit")
    rows = map_texts(best, measure, "h long, check long, n int").toArrow()
    return rows.column("h").to_numpy().view(np.uint64), rows.column("check").to_numpy().view(np.uint64), rows.column("n").to_numpy()


def token_counts(documents: DataFrame, model: str, limit: int = LIMIT, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``documents``.

    A null text counts as empty: 0 bytes, 0 tokens.  doc_id may be null or
    repeated.  Other columns are not read.  An empty table gives an empty result.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(_frequent(docs.select("text"), model, table))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *known, lengths = shared.value
        first, cache = HashTable(*known), _piece_model(model)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            total = np.zeros(len(offsets) - 1, dtype=np.int64)
            for a, b in slices(offsets):
                part, at, starts, ends, h, check = _units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = first.find(h, check)
                n = np.zeros(len(h), dtype=np.int64)
                hit = row >= 0
                n[hit] = lengths[row[hit]]
                miss = np.flatnonzero(~hit)
                if len(miss):
                    n[miss] = cache.look_up(h[miss], check[miss], part.tobytes(), starts[miss], ends[miss])[1]
                upto = np.concatenate(([0], np.cumsum(n)))
                total[a:b] = np.diff(upto[np.searchsorted(starts, at)])
            bytes_ = np.diff(offsets)
            total[bytes_ == 0] = 0  # the model puts no space before an empty text
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bytes_, pa.int64()), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
