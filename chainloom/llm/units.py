"""Pieces of text that a tokenizer encodes independently, and worker caches of their codes.

The cut rules only ever cut where the tokenizer itself must end a token, so the
codes of a text are the codes of its units in turn.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textkernel import GrowingTable

#: Last bytes of the white space characters beyond ASCII, by the bytes before them.
_WIDE_SPACE = {(0xC2,): (0x85, 0xA0), (0xE1, 0x9A): (0x80,), (0xE2, 0x80): (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), (0xE2, 0x81): (0x9F,), (0xE3, 0x80): (0x80,)}


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space, letter, mark = (np.zeros(256, dtype=bool) for _ in range(3))
    space[[9, 10, 11, 12, 13, 32]] = True
    letter[65:91] = letter[97:123] = True
    mark[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    return space, letter, mark


_SPACE, _LETTER, _MARK = _classes()


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` is white space or an ASCII control."""
    last = data[at]
    out = last <= 0x20
    out |= last == 0x7F
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        p = at[wide]
        one, two = data[np.maximum(p - 1, 0)], data[np.maximum(p - 2, 0)]
        hit = np.zeros(len(wide), dtype=bool)
        for lead, tails in _WIDE_SPACE.items():
            before = one == lead[-1]
            if len(lead) == 2:
                before &= two == lead[0]
            hit |= before & np.isin(last[wide], tails)
        out[wide] = hit
    return out


def byte_bpe_units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units for byte-level BPE with the usual split pattern.

    A unit begins at each text, at white space after anything else, at an ASCII
    mark after an ASCII letter and the reverse, and at a letter after a single
    line feed.  Marks that may belong to a contraction or a special token
    (apostrophe, vertical bar) begin and end nothing.
    """
    n = len(data)
    begin = np.zeros(n, dtype=bool)
    if n < 2:
        begin[:1] = True
        return np.flatnonzero(begin)
    now, was = data[1:], data[:-1]
    at = np.flatnonzero(_SPACE[now]) + 1
    begin[at[~_ends_in_space(data, at - 1)]] = True
    mark = _MARK.copy()
    mark[[0x27, 0x7C]] = False
    begin[1:] |= (_LETTER[was] & mark[now]) | (mark[was] & _LETTER[now])
    line = np.flatnonzero((was == 10) & _LETTER[now]) + 1
    alone = line[line >= 2]
    begin[alone[~_ends_in_space(data, alone - 2)]] = True
    begin[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(begin)


def piece_units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units for a piece model whose pieces hold white space only in front: runs of spaces begin units."""
    n = len(data)
    begin = np.zeros(n, dtype=bool)
    if n > 1:
        at = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
        # U+2581 in a text is the same to the model as a space
        sign = (data[at - 1] == 0x81) & (data[np.maximum(at - 2, 0)] == 0x96) & (data[np.maximum(at - 3, 0)] == 0xE2)
        begin[at[~sign]] = True
    begin[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(begin)


class UnitCache:
    """Codes of units by two 64-bit hashes, in one growing pool; it starts anew when full, so its memory is bounded.

    A unit takes about 40 bytes and its codes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.table = GrowingTable(self.limit, checked=True)
        self.first, self.size = np.zeros(self.limit, dtype=np.int32), np.zeros(self.limit, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 14, dtype=np.int32), 0

    def look_up(self, hashes: np.ndarray, checks: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First pool position and number of codes of each unit."""
        slot = self.table.find(hashes, checks)
        miss = np.flatnonzero(slot < 0)
        while len(miss):  # again only for units that share their first hash
            unique, where = np.unique(hashes[miss], return_index=True)
            if self.table.used + len(unique) > self.limit:
                self.limit = max(self.limit, len(hashes))
                self._reset()
                return self.look_up(hashes, checks, raw, starts, ends)
            new = miss[where]
            codes, sizes = self.encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            if self.used + len(codes) > len(self.pool):
                grown = np.zeros(max(self.used + len(codes), len(self.pool) * 3 // 2), dtype=np.int32)
                grown[: self.used] = self.pool[: self.used]
                self.pool = grown
            self.pool[self.used : self.used + len(codes)] = codes
            rows = self.table.add(unique, checks[new])
            self.size[rows] = sizes
            self.first[rows] = self.used + np.cumsum(sizes) - sizes
            self.used += len(codes)
            slot[miss] = self.table.find(hashes[miss], checks[miss])
            miss = miss[slot[miss] < 0]
        return self.first[slot].astype(np.int64), self.size[slot]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions ``first[k] .. first[k] + size[k] - 1`` for all k in turn."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_DIGIT = np.array([48 <= c < 58 for c in range(256)])


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units for a model of words that drops white space and splits letters, digits and marks.

    Units never hold ASCII white space.  They also end between two ASCII characters of
    unlike kinds (letter, digit, mark) and after every digit; an apostrophe and a vertical
    bar, which may belong to a contraction or a special token, end nothing.
    """
    kind = np.zeros(256, dtype=np.uint8)
    kind[_LETTER], kind[_MARK], kind[_DIGIT] = 1, 2, 3
    kind[[0x27, 0x7C]] = 0
    now = kind[data]
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # before each byte
    if len(data) > 1:
        cut[1:-1] = (now[1:] > 0) & (now[:-1] > 0) & ((now[1:] != now[:-1]) | (now[1:] == 3))
        cut[1:-1] |= solid[1:] != solid[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1] & solid), np.flatnonzero(cut[1:] & solid) + 1
