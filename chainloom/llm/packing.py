"""Sequences of bounded length packed from whole documents by the sum-of-squares rule.

A piece goes where the sum, over all residual gaps, of the squared number of open
sequences with that gap becomes smallest (Csirik, Johnson, Kenyon, Orlin, Shor, Weber
2006).  Taking a gap ``g`` to ``g - s`` changes the sum by ``2 (n[g - s] - n[g]) + 2``,
a new sequence by ``2 n[C - s] + 1``, filling a gap takes ``2 n[g] - 1`` away; ties go
to the tightest gap.  Pieces of at least a sixteenth of the capacity come first,
longest first; the rest, in a seeded order, fill the gaps.

Scale: all pieces are ranked by that order (a range shuffle of rows without texts) and
dealt to shards in turn, so every shard has the same mix of lengths however many copies
or rows of one kind there are.  A shard is packed by itself in one streaming task that
holds a count and the open sequences for each gap; it loses about one sequence.  Token
ids move once, by the sequence that they end in.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank
from .textkernel import slices, span_pairs, texts_of
from .units import UnitCache, spread, word_units
from .workspace import map_texts, materialise

CAPACITY, END_ID, SHARD_TOKENS, LARGE = 4096, 1, 8 << 20, 16
_WORD_END = "</w>"


def _one_word(unit: bytes) -> bool:
    """Whether the model certainly takes the unit as one word: letters alone, marks alone, or a digit."""
    if unit.isascii():
        return unit.isalpha() or unit.isdigit() or (b"'" not in unit and b"|" not in unit and unit.isascii() and all(33 <= c < 127 and not chr(c).isalnum() for c in unit))
    text = unicodedata.normalize("NFC", unit.decode())
    return text.isalpha() and max(text) < "ɐ" and "İ" not in text  # Latin letters


@lru_cache(maxsize=2)
def _word_model(path: str) -> UnitCache:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    closes = np.array([(model.id_to_token(i) or "").endswith(_WORD_END) for i in range(model.get_vocab_size(with_added_tokens=True))])

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded in runs with spaces between, each ending in a closing token; other units by themselves."""
        runs: list[list[int]] = []
        length = 4001
        for k, unit in enumerate(units):
            if not _one_word(unit):
                runs.append([k])
                length = 4001
            elif length > 4000:
                runs.append([k])
                length = len(unit)
            else:
                runs[-1].append(k)
                length += len(unit)
        found = model.encode_batch_fast([b" ".join(units[k] for k in run).decode() for run in runs], add_special_tokens=False)
        sizes, codes = np.zeros(len(units), dtype=np.int32), []
        for run, e in zip(runs, found):
            ids = np.array(e.ids, dtype=np.int32)
            codes.append(ids)
            if len(run) == 1:
                sizes[run[0]] = len(ids)
            else:
                sizes[run] = np.diff(np.flatnonzero(closes[ids]), prepend=-1)
        return np.concatenate(codes), sizes

    return UnitCache(encode)


def _pieces(tokenizer: str, capacity: int, end_id: int, with_ids: bool, id_type: pa.DataType):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"][:with_ids]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _word_model(tokenizer)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends = word_units(part, at)
                first, size = cache.look_up(*span_pairs(part, starts, ends), part.tobytes(), starts, ends) if len(starts) else (starts, starts)
                upto = np.concatenate(([0], np.cumsum(size)))
                tokens = np.diff(upto[np.searchsorted(starts, at)]) + 1
                out = np.full(int(tokens.sum()), end_id, dtype="<u4")
                keep = np.ones(len(out), dtype=bool)
                keep[np.cumsum(tokens) - 1] = False
                out[keep] = cache.pool[spread(first, size)]
                count = -(-tokens // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = spread(np.zeros(b - a, dtype=np.int64), count)
                length = np.minimum(tokens[row] - piece * capacity, capacity)
                cuts = np.concatenate(([0], np.cumsum(length))) * 4
                raw = memoryview(out.tobytes())
                sums = [zlib.crc32(raw[x:y]) for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
                columns = [batch.column("doc_id").slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(raw[x:y]) for x, y in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The documents' ids and an end id, cut into pieces of ``capacity``: doc_id, piece, start, length, ids_crc32.

    With ``with_ids`` also ``ids``, little-endian unsigned 32-bit integers.  A null text
    is empty and has the end id alone.  Rows without doc_id or with a repeated one have
    pieces of their own.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema["doc_id"].dataType
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_texts(docs, _pieces(tokenizer, capacity, end_id, with_ids, to_arrow_type(kind)), schema)


class OpenSequences:
    """The open sequences of a shard by residual gap."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> tuple[int, int]:
        """The sequence that a piece goes to, and its place there."""
        n, never = self.count, np.iinfo(np.int64).max
        change = np.where(n[size:] > 0, 2 * (n[: len(n) - size] - n[size:]) + 2, never)  # by the gap that remains
        if n[size] > 0:
            change[0] = 1 - 2 * n[size]
        rest = int(np.argmin(change))
        fresh = 2 * n[self.capacity - size] + 1 if size < self.capacity else never - 1
        if change[rest] <= fresh and change[rest] < never:
            gap = rest + size
            sequence = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, rest = self.capacity, self.capacity - size
            sequence, self.made = self.made, self.made + 1
        if rest:
            n[rest] += 1
            self.open.setdefault(rest, []).append(sequence)
        return sequence, self.capacity - gap


def _pack(capacity: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, OpenSequences(capacity)
        for batch in batches:
            ids, offsets = [], []
            for shard, length in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist()):
                if shard != now:
                    now, state = shard, OpenSequences(capacity)
                sequence, at = state.place(length)
                ids.append(shard << 32 | sequence)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to written rows with a ``length`` from 1 to ``capacity``; see the module.

    Equal rows are interchangeable, so reruns agree for any partitioning.  An empty
    table gives an empty result.
    """
    tokens = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, round(tokens / shard_tokens))
    names = pieces.columns
    large = F.col("length") * LARGE >= capacity
    ranked = global_rank(pieces.select(*names, F.when(large, -F.col("length")).otherwise(0).alias("first"), F.xxhash64(F.lit("pack"), *names).alias("then")), ["first", "then", *names])
    dealt = ranked.select(*names, (F.col("rank") % shards).alias("shard"), "rank").repartitionByRange("shard").sortWithinPartitions("shard", "rank")
    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return dealt.mapInArrow(_pack(capacity, names), f"{kinds}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(materialise(token_pieces(documents, tokenizer, capacity), "pieces"), capacity, shard_tokens)


def packed_sequences(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The sequences themselves: sequence_id, ``ids`` (little-endian unsigned 32-bit integers) and ``pieces``, what each holds in order."""
    pieces = materialise(token_pieces(documents, tokenizer, capacity, with_ids=True).withColumn("tag", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.drop("ids"), capacity, shard_tokens)
    whole = placed.join(pieces.select("tag", "ids").hint("merge"), "tag")
    one = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    rows = whole.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("x"))  # at most ``capacity`` ids
    listed = F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset")))
    joined = F.aggregate("x", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), listed.alias("pieces"))
