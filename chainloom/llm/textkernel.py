"""Vectorised helpers over Arrow batches of texts.

A task sees one Arrow batch at a time and works through it in slices of about
``SLICE`` bytes of text, so memory follows the slice or the longest text, never
the partition.  Words are maximal runs of bytes outside 0x20 and 0x09-0x0D;
these bytes never occur inside a multi-byte UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

SLICE, _LONG = 1 << 20, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the rounds.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) if salt else h.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lower()[data]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    size = ends - starts
    h = mix(size.astype(np.uint64) * _ODD, salt + 1)
    check = mix(h, 77) if both else h
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, dtype=np.uint8))), strides=(1,))  # eight bytes from each place
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    at, rest = starts[left], size[left]
    while len(left):
        lane = lanes[at] & _MASKS[np.minimum(rest, 8)]
        h[left] = _turn(h[left] ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        if both:
            own = (check[left] ^ lane) * _P3
            check[left] = (own ^ (own >> np.uint64(29))) * _P5
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    long = np.flatnonzero(size > _LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        raw = b"".join(xxhash.xxh3_128_digest(view[s:e], salt) for s, e in zip(starts[long].tolist(), ends[long].tolist()))
        wide = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
        h[long] ^= wide[:, 0]
        if both:
            check[long] ^= wide[:, 1]
    return mix(h), mix(check, 78) if both else h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[starts, ends)``.

    Short ranges take a multiply-and-rotate round for every eight bytes, long ones a
    library hash.  No step is linear in the bytes, so patterned texts do not collide
    by their form, and ranges of eight bytes or fewer of one length never collide.
    """
    return _hashes(data, starts, ends, salt, False)[0]


def span_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same hashes, and as many bits by other rounds, to tell apart what shares a hash."""
    return _hashes(data, starts, ends, 0, True)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.string())
    wide = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if column.type in (pa.binary(), pa.large_binary()) else "")
    _, offsets, data = column.buffers()
    size = len(column)
    if offsets is None or size == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(size + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + size + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row is alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the rows, and the row of each word."""
    solid = ~_space()[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a row's end also ends a word
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def grouped(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of ``n`` rows in an ascending array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class GrowingTable:
    """An open-addressing map from 64-bit hashes to row numbers in order of addition, probed by whole arrays.

    With ``checked`` a key is a hash and a second one, and both must agree.
    """

    def __init__(self, limit: int, checked: bool = False):
        self.bits = max(4, int(np.ceil(np.log2(max(limit, 1) * 1.7))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys, self.used = np.zeros(max(limit, 1), dtype=np.uint64), 0
        self.checks = np.zeros(max(limit, 1), dtype=np.uint64) if checked else None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Row numbers of keys that the table lacks; they must differ."""
        rows = np.arange(self.used, self.used + len(keys), dtype=np.int32)
        self.keys[rows] = keys
        if self.checks is not None:
            self.checks[rows] = checks
        self.used += len(keys)
        todo, at = rows, self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        return rows

    def find(self, wanted: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Row numbers, -1 where absent."""
        found = np.full(len(wanted), -1, dtype=np.int32)
        at = self._home(wanted)
        left = np.arange(len(wanted))
        while len(left):
            row = self.slots[at]
            hit = (row >= 0) & (self.keys[row] == wanted[left])
            if self.checks is not None:
                hit &= self.checks[row] == checks[left]
            found[left[hit]] = row[hit]
            more = (row >= 0) & ~hit
            left, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return found


class HashTable(GrowingTable):
    """The same with all its keys from the start."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray | None = None):
        super().__init__(len(keys), checks is not None)
        self.add(np.asarray(keys, dtype=np.uint64), checks)
