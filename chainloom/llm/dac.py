"""Token ids in directly addressable files.

Every id is split into chunks of ``BITS`` bits.  Level 0 holds the low chunk of
all ids, level k the k-th chunk of the ids that have one, and a bitmap at each
level marks the ids that go on.  A rank directory with the number of marks before
each block of 512 gives an id's place at the next level, so any id is read from
one byte a level without decoding its neighbours (Brisaboa, Ladra, Navarro 2013).

Layout (little-endian): magic, levels, documents, ids; then doc_id, a null mark
and the first id's place of each document; then for each level its length,
chunks, bitmap and rank directory.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import cut_keys, rows_a_run, run_of, sortable
from .textkernel import slices, span_pairs, texts_of
from .units import UnitCache, byte_bpe_units, spread
from .workspace import filesystem, fresh_dir, map_texts, publish

MAGIC, BITS, RANK = b"DAC1", 8, 512
END_ID, ROLL_IDS, FILE_BYTES, TASK_BYTES = 0, 4_000_000, 8 << 20, 32 << 20  # bytes of text in a run; bytes of files in a reading task
_HEAD = struct.Struct("<4sIQQ")
MANIFEST = "shard int, roll int, path string, n_docs long, n_ids long, bytes long, first_doc long, last_doc long, crc32 long"


def encode_file(doc_ids: np.ndarray, null_ids: np.ndarray, first: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: ``first`` has a place for each document and the total."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(BITS)
        marks = more > 0
        bits = np.packbits(marks, bitorder="little")
        per_block = np.add.reduceat(marks, np.arange(0, len(marks), RANK), dtype=np.int64) if len(marks) else np.zeros(0, dtype=np.int64)
        rank = (np.cumsum(per_block) - per_block).astype("<u4")
        levels += [struct.pack("<Q", len(rest)), (rest & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()]
        if not marks.any():
            break
        rest = more[marks]
    head = _HEAD.pack(MAGIC, len(levels) // 4, len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), null_ids.astype(np.uint8).tobytes(), first.astype("<i8").tobytes(), *levels])


class DacFile:
    """Reads one file's bytes."""

    def __init__(self, raw: bytes):
        magic, levels, docs, self.n_ids = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.null_ids, self.first = take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", -(-n // RANK))))

    def _marks_before(self, level: int, at: int) -> int:
        _, bits, rank = self.levels[level]
        block = at // RANK
        if block == len(rank):  # only the end of a level that fills its last block
            block -= 1
        if block < 0:
            return 0
        part = np.unpackbits(bits[block * RANK // 8 : -(-at // 8)], bitorder="little")[: at - block * RANK]
        return int(rank[block]) + int(part.sum())

    def get(self, at: int) -> int:
        """One id, by one byte a level."""
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (BITS * k)
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            at = self._marks_before(k, at)
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids in a range, without decoding what is before it."""
        out = np.zeros(stop - start, dtype=np.uint32)
        here = np.arange(stop - start)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[here] |= chunks[start:stop].astype(np.uint32) << np.uint32(BITS * k)
            base = start // 8
            marks = np.unpackbits(bits[base : -(-stop // 8)], bitorder="little")[start - base * 8 : stop - base * 8].astype(bool)
            here, start = here[marks], self._marks_before(k, start)
            stop = start + int(marks.sum())
        return out


@lru_cache(maxsize=2)
def _byte_bpe(path: str) -> UnitCache:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    size = model.get_vocab_size(with_added_tokens=True)
    width = np.array([len(model.id_to_token(i) or "") for i in range(size)])  # a character stands for a byte

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin with one space and end in a mark, letter or digit are encoded in runs: their borders end tokens."""
        joins = [len(u) > 1 and u[0] == 32 and 32 < u[1] < 127 and 32 < u[-1] < 127 for u in units]
        runs: list[list[int]] = []
        length = 0
        for k, ok in enumerate(joins):
            if not ok or not runs or length > 4000 or not joins[runs[-1][-1]]:
                runs.append([])
                length = 0
            runs[-1].append(k)
            length += len(units[k])
        found = model.encode_batch_fast([b"".join(units[k] for k in run).decode() for run in runs], add_special_tokens=False)
        sizes = np.zeros(len(units), dtype=np.int32)
        codes = []
        for run, e in zip(runs, found):
            ids = np.array(e.ids, dtype=np.int32)
            codes.append(ids)
            if len(run) == 1:
                sizes[run[0]] = len(ids)
            else:
                ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(units[k]) for k in run])) + 1
                sizes[run] = np.diff(ends, prepend=0)
        return np.concatenate(codes), sizes

    return UnitCache(encode)


def _encode_texts(tokenizer: str):
    """Iterates slices of a batch: row range, ids of all rows in turn, ids a row; the end id closes each row."""
    cache = _byte_bpe(tokenizer)

    def run(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for a, b in slices(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = byte_bpe_units(part, at)
            ends = np.append(starts[1:], len(part)).astype(np.int64) if len(starts) else starts
            first, size = cache.look_up(*span_pairs(part, starts, ends), part.tobytes(), starts, ends) if len(starts) else (starts, starts)
            upto = np.concatenate(([0], np.cumsum(size)))
            per = np.diff(upto[np.searchsorted(starts, at)])
            out = np.full(int(per.sum()) + b - a, END_ID, dtype=np.uint32)
            keep = np.ones(len(out), dtype=bool)
            keep[np.cumsum(per + 1) - 1] = False
            out[keep] = cache.pool[spread(first, size)]
            yield a, b, out, per + 1

    return run


def _writer(tokenizer: str, folder: str, roll_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        encode = _encode_texts(tokenizer)
        docs, nulls, counts, codes, held, roll, rows = [], [], [], [], 0, 0, []
        now = None

        def flush() -> None:
            nonlocal held, roll
            if not counts:
                return
            d, z, c = np.concatenate(docs), np.concatenate(nulls), np.concatenate(counts)
            raw = encode_file(d, z, np.concatenate(([0], np.cumsum(c))), np.concatenate(codes))
            name = f"part-{now:06d}-{roll:05d}.dac"
            with where.open_output_stream(f"{root}/{name}.{attempt}.tmp") as out:
                out.write(raw)
            where.move(f"{root}/{name}.{attempt}.tmp", f"{root}/{name}")
            known = d[~z]
            lo, hi = (int(known[0]), int(known[-1])) if len(known) else (None, None)
            rows.append((now, roll, f"{folder}/{name}", len(d), int(c.sum()), len(raw), lo, hi, zlib.crc32(raw)))
            for x in (docs, nulls, counts, codes):
                x.clear()
            held, roll = 0, roll + 1

        for batch in batches:
            ids, run_ = batch.column("doc_id"), batch.column("run").to_numpy()
            known, values = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            data, offsets = texts_of(batch.column("text"))
            borders = np.flatnonzero(np.diff(run_, prepend=run_[:1] - 1)).tolist() + [len(run_)] if len(run_) else []
            for lo, hi in zip(borders, borders[1:]):  # rows of one run
                if run_[lo] != now:
                    flush()
                    now, roll = int(run_[lo]), 0
                for a, b, out, per in encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    docs.append(values[lo + a : lo + b])
                    nulls.append(known[lo + a : lo + b])
                    counts.append(per)
                    codes.append(out)
                    held += len(out)
                    if held >= roll_ids:
                        flush()
        flush()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def write_token_files(documents: DataFrame, tokenizer: str, folder: str | None = None, roll_ids: int = ROLL_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all texts and write files in ascending doc_id order; returns the manifest with each file's ``start``.

    The order is cut into runs of equally many rows, about ``file_bytes`` of text, at
    places that depend on the rows alone; each run goes to one task, which encodes it
    and writes its files, a new one after ``roll_ids`` ids, under temporary names that
    it then renames.  So a task that runs again, or another run over the same rows,
    leaves the same files.  The manifest is written beside them and lists what counts.
    A null text is empty and has the end id alone; rows without doc_id come first; rows
    that repeat a doc_id follow each other by a hash of the text.  An empty table gives
    an empty manifest.
    """
    spark = documents.sparkSession
    folder = folder or fresh_dir(spark, "ids")
    where, root = filesystem(folder)
    where.create_dir(root, recursive=True)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.concat(sortable(F.col("doc_id")), sortable(F.xxhash64("text")))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(1))).first()
    cuts = cut_keys(docs.select(key.alias("key")), rows_a_run(rows, size, file_bytes))
    ordered = docs.withColumn("key", key).withColumn("run", run_of(F.col("key"), cuts)).repartition("run").sortWithinPartitions("run", "key", "text")
    manifest = publish(map_texts(ordered.select("doc_id", "run", "text"), _writer(tokenizer, folder, roll_ids), MANIFEST), folder, "manifest")
    before = Window.orderBy("shard", "roll").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, crc in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "crc32"))):
                where, at = filesystem(path)
                with where.open_input_stream(at, compression=None) as source:
                    raw = source.read()
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"{path} is damaged")
                file = DacFile(raw)
                first, docs = file.first, len(file.doc_ids)
                sums = np.zeros(docs, dtype=np.int64)
                lo = 0
                while lo < docs:  # about a million ids at a time
                    hi = min(docs, max(lo + 1, int(np.searchsorted(first, first[lo] + 1_000_000, side="right")) - 1))
                    ids = memoryview(file.read(int(first[lo]), int(first[hi])).astype("<u4").tobytes())
                    cut = ((first[lo : hi + 1] - first[lo]) * 4).tolist()
                    sums[lo:hi] = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:])]
                    lo = hi
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, mask=file.null_ids), pa.array(first[:-1] + start), pa.array(np.diff(first)), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    listed = manifest.select("path", "start", "crc32")
    return listed.repartition(max(1, -(-size // TASK_BYTES)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(documents: DataFrame, tokenizer: str, roll_ids: int = ROLL_IDS) -> DataFrame:
    """Write the files, then return what they hold: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(documents, tokenizer, roll_ids=roll_ids))
