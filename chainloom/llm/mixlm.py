"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens, lower-cased words and one end, and every token is
written as the bits of a prefix code: a known word (one of the ``FREQUENT`` most
counted, at least twice) by its place in a Huffman tree over the counted words, any
other word by an escape and then its bytes and a closing byte, each by its place in a
second tree.  ``PREDICTORS`` predictors guess each bit.  For words their contexts are
none (the word counts themselves), the last one, two and three words, the word before
last, and the last word's ending; for bytes the place in the word, the last one, two
and three bytes, the word's whole beginning, and that with the word before.  Each keeps
counts of zeros and ones in a hashed table, gathered by tasks over all training texts
and merged by table part.  A slot's counts are kept as a code of two rounded counts;
what a code says in log odds is measured on the training bits themselves, each left
out of its own slot.

The log odds are summed with weights that a gate chooses, by how many predictors know
the context.  The weights start from values learned online over all training texts,
again with each bit left out, in buckets of texts dealt by a hash, whose weights are
averaged, so a model depends on the rows alone.  In scoring they go on to follow each
text's own errors block by block.  A last table refines the mixed probability by what
it has turned out to mean, and how far it is trusted follows the text's errors too.
A text's score is the log10 probability of all its tokens; bits per byte follow.

Scale: the vocabulary, tables and weights have a bounded size, and a text is worked on
in slices.  The base score's counts come from a table of all words: texts look up the
frequent ones in the broadcast vocabulary; rarer ones are joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import most_frequent
from .textkernel import HashTable, grouped, list_array, lower_ascii, mix, slices, span_hashes, texts_of, words
from .units import spread
from .workspace import map_texts, materialise

PREDICTORS, LEAST_BITS, MOST_BITS = 6, 14, 21  # least and most bits of a table's size
FREQUENT, BLOCK, CHUNK = 1 << 18, 1 << 16, 1 << 14
COUNTING, COUNTERS, BUCKET, BUCKETS = 1 << 25, 4096, 1 << 22, 16384  # bytes of a counting task and most of these; the same for learning
STEP, MOST_STEP, CLOSE = 16, 512, 32  # least and most tokens between changes of a text's weights; the byte that closes a spelled word
_SETS, _CELLS, _SMOOTH, _RATE, _CALM = 2 * (PREDICTORS + 1), 49, 0.05, 0.02, 16.0
_GOLD, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x1F83D9ABFB41BD6B)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data[spread(starts, size)].tobytes())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, n): each distinct word of a batch and its number in the training texts."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        trains = batch.column("class").to_numpy() == 0
        found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        for a, b in slices(offsets):
            part, at = lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            starts, ends, row = words(part, at)
            h, where, inverse = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
            found.append((h, _gather(part, starts[where], ends[where]), np.bincount(inverse[trains[a + row]], minlength=len(h))))
        if not found:
            continue
        h, where, inverse = np.unique(np.concatenate([x[0] for x in found]), return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([x[2] for x in found]), minlength=len(h)).astype(np.int64)
        word = pa.concat_arrays([x[1] for x in found]).take(pa.array(where))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), word, pa.array(n)], ["h", "word", "n"])


# ---- codes

def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of symbols given in descending order of their counts."""
    n = len(counts)
    weight = [float(c) for c in counts[::-1]] + [0.0] * (n - 1)
    parent = [0] * (2 * n - 1)
    leaf, node = 0, n
    for new in range(n, 2 * n - 1):
        total = 0.0
        for _ in range(2):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, node = node, node + 1
            total += weight[pick]
            parent[pick] = new
        weight[new] = total
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return np.array(depth[:n][::-1], dtype=np.int64)


def prefix_codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code (behind a leading one) and length of each symbol: canonical, shorter codes first, counts descending."""
    length = code_lengths(counts)
    order = np.argsort(length, kind="stable")
    most = int(length.max())
    room = np.uint64(1) << (most - length[order]).astype(np.uint64)
    start = np.cumsum(room) - room
    code = np.empty(len(counts), dtype=np.uint64)
    code[order] = (start >> (most - length[order]).astype(np.uint64)) | (np.uint64(1) << length[order].astype(np.uint64))
    return code, length


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """Codes of bytes: short for letters and the closing byte."""
    weight = np.ones(256)
    weight[33:127] = 4
    weight[128:] = 4
    weight[48:58] = 6
    weight[97:123] = 32
    weight[CLOSE] = 128
    order = np.argsort(-weight, kind="stable")
    code, length = np.empty(256, dtype=np.uint64), np.empty(256, dtype=np.int64)
    code[order], length[order] = prefix_codes(weight[order])
    return code, length


_BYTE_CODE, _BYTE_LENGTH = _byte_codes()


class Vocabulary:
    """Known words by hash, their counts and codes; the end and the escape have codes too."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, others: int):
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts = hashes[order], counts[order]
        every = np.concatenate((self.counts, [max(ends, 1), max(others, 1)])).astype(np.float64)
        by = np.argsort(-every, kind="stable")
        self.code, self.length = np.empty(len(every), dtype=np.uint64), np.empty(len(every), dtype=np.int64)
        self.code[by], self.length[by] = prefix_codes(every[by])

    def table(self) -> HashTable:
        return HashTable(self.hashes)


class Steps:
    """What is to be coded in some texts: a step is a token or a byte of a spelled word, with its code and contexts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, table: HashTable):
        low = lower_ascii(data)
        starts, ends, row = words(low, offsets)
        n = len(offsets) - 1
        self.starts, self.row, self.hash = starts, row, span_hashes(low, starts, ends)
        self.symbol = table.find(self.hash).astype(np.int64)
        known = self.symbol >= 0
        last, escape = len(vocabulary.counts), len(vocabulary.counts) + 1
        # items: the words of each text and its end
        place = np.arange(len(row)) + row
        upto = grouped(row, n)
        ending = upto[1:] + np.arange(n) if n else np.zeros(0, dtype=np.int64)
        items = len(row) + n
        symbol, extra, name, tail = np.full(items, last), np.zeros(items, dtype=np.int64), np.full(items, _START), np.zeros(items, dtype=np.uint64)
        symbol[place] = np.where(known, self.symbol, escape)
        extra[place] = np.where(known, 0, ends - starts + 1)
        name[place] = self.hash
        size = ends - starts
        for k in range(3):
            tail[place] = tail[place] * np.uint64(256) + np.where(size > k, low[np.maximum(ends - 1 - k, 0)], 0).astype(np.uint64)
        lane = np.zeros(items, dtype=np.int64)
        lane[place], lane[ending] = row, np.arange(n)
        since = np.arange(items) - np.append(0, ending[:-1] + 1)[lane] if items else np.zeros(0, dtype=np.int64)
        before = []
        for k in (1, 2, 3):
            b = np.full(items, _START)
            b[k:] = np.where(since[k:] >= k, name[: max(items - k, 0)], _START)
            before.append(b)
        ended = np.zeros(items, dtype=np.uint64)
        ended[1:] = np.where(since[1:] >= 1, tail[:-1], 0)
        two = before[0] * _GOLD + before[1]
        contexts = [np.zeros(items, dtype=np.uint64), before[0], two, two * _GOLD + before[2], before[1], ended]
        # steps: each item, and the bytes of those that are spelled
        steps = 1 + extra
        item = np.repeat(np.arange(items), steps)
        within = np.arange(len(item)) - np.repeat(np.cumsum(steps) - steps, steps)
        self.lane, self.lanes = lane[item], n
        self.kind = (within > 0).astype(np.int64)
        self.code, self.length = vocabulary.code[symbol][item], vocabulary.length[symbol][item]
        self.context = np.stack([(mix(c, salt=k + 1) >> np.uint64(32)).astype(np.uint32)[item] for k, c in enumerate(contexts)])
        at = np.flatnonzero(within > 0)
        if len(at):
            origin = np.zeros(items, dtype=np.int64)
            origin[place] = starts
            j = within[at] - 1
            here = origin[item[at]] + j
            closing = j + 1 == extra[item[at]]
            byte = np.where(closing, CLOSE, low[np.minimum(here, len(low) - 1)])
            self.code[at], self.length[at] = _BYTE_CODE[byte], _BYTE_LENGTH[byte]
            back = [np.where(j >= k, low[np.maximum(here - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) for k in (1, 2, 3)]
            pairs = back[0] * np.uint64(257) + back[1]
            beginning = _beginnings(back[0], j)
            spelled = [np.minimum(j, 12).astype(np.uint64), back[0], pairs, pairs * np.uint64(257) + back[2], beginning, beginning + before[0][item[at]] * _GOLD]
            for k, c in enumerate(spelled):
                self.context[k, at] = (mix(c, salt=k + 1 + PREDICTORS) >> np.uint64(32)).astype(np.uint32)


def _beginnings(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A running hash of the bytes of each word before each place; words that share one share slots, no more."""
    base = 0xD6E8FEB86659FD93
    n = len(byte)
    power, inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, b, dtype=np.uint64)))) for b in (base, pow(base, -1, 2**64)))
    sums = np.cumsum(mix(np.where(place > 0, byte, np.uint64(0))) * power[:n], dtype=np.uint64)
    first = np.maximum.accumulate(np.where(place == 0, np.arange(n), 0))
    return (sums - sums[first]) * inverse[first]


class _Bits:
    """The bits of all steps in turn: node in the code tree, value, and each predictor's slot."""

    def __init__(self, steps: Steps, order: np.ndarray | slice, sizes: tuple[int, ...]):
        code, self.length = steps.code[order], steps.length[order]
        self.ends = np.cumsum(self.length)
        self.first = self.ends - self.length
        total = int(self.ends[-1]) if len(self.ends) else 0
        whole = np.repeat(code, self.length)
        left = (np.repeat(self.ends, self.length) - np.arange(total)).astype(np.uint64)
        node = whole >> left
        self.bit = ((whole >> (left - np.uint64(1))) & np.uint64(1)).astype(np.uint8)
        node += np.repeat(steps.kind[order].astype(np.uint64) << np.uint64(62), self.length)
        node *= _GOLD
        self.node = (node >> np.uint64(32)).astype(np.uint32)
        self.context, self.order, self.sizes = steps.context, order, sizes

    def slots(self, k: int) -> np.ndarray:
        at = np.repeat(self.context[k][self.order], self.length)
        at += self.node
        at >>= np.uint32(32 - self.sizes[k])
        return at.astype(np.int64)


# ---- counts

def _levels() -> np.ndarray:
    """Least counts of the levels 1 to 63 that a count is rounded to: 1 to 8 exactly, then by quarters."""
    return np.concatenate((np.arange(1, 9), np.ceil(8 * 1.25 ** np.arange(1, 56))))


_LEAST = _levels()
_MIDDLE = np.concatenate((np.arange(9), np.sqrt(_LEAST[8:] * np.append(_LEAST[9:], _LEAST[-1] * 1.25))))


def table_bits(tokens: int, kinds: int) -> tuple[int, ...]:
    """Bits of each predictor's table for so many training tokens of so many kinds.

    A token has some twenty bits, and a table has a slot for each until it reaches
    ``MOST_BITS``: each counting task holds all tables, at 8 bytes a slot.  The first
    predictor has no context and needs a slot for each node of the tree.
    """
    most = [min(20 * tokens, 4 * kinds + 4096), *[20 * tokens] * (PREDICTORS - 1)]
    return tuple(min(max(int(m).bit_length(), LEAST_BITS), MOST_BITS) for m in most)


_PACKED = (np.dtype("<u2"), np.dtype("<i4"), np.dtype("<i4"))  # steps between slots, zeros, ones


def _pack(at: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> bytes:
    """Slots in ascending order with their counts, byte by byte of their digits and compressed: most counts are 0 or 1."""
    columns = (np.diff(at, prepend=0), zeros, ones)
    planes = [x.astype(t).view(np.uint8).reshape(-1, t.itemsize).T.ravel() for x, t in zip(columns, _PACKED)]
    return pa.Codec("zstd").compress(np.concatenate(planes).tobytes(), asbytes=True)


def _unpack(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(packed, n * sum(t.itemsize for t in _PACKED), asbytes=True), np.uint8)
    ends = np.cumsum([n * t.itemsize for t in _PACKED])
    steps, zeros, ones = (np.ascontiguousarray(x.reshape(t.itemsize, n).T).view(t).ravel() for x, t in zip(np.split(raw, ends[:-1]), _PACKED))
    return np.cumsum(steps, dtype=np.int64), zeros, ones


def _bit_counts(shared, sizes: tuple[int, ...]):
    first = np.concatenate(([0], np.cumsum([1 << b for b in sizes])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, n, packed): what this task's training texts add to ``n`` slots of each part of the tables."""
        vocabulary = shared.value
        table = vocabulary.table()
        sums = np.zeros(2 * first[-1], dtype=np.int32)  # a zero and a one beside each other
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in slices(offsets, BLOCK):
                bits = _Bits(Steps(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vocabulary, table), slice(None), sizes)
                for k in range(len(sizes)):
                    at = bits.slots(k)
                    at *= 2
                    at += bits.bit
                    np.add.at(sums[2 * first[k] : 2 * first[k + 1]], at, np.int32(1))
        used, sums = sums.view(np.int64), sums.reshape(-1, 2)  # neither count is negative
        for c, a in enumerate(range(0, int(first[-1]), CHUNK)):
            part = sums[a : a + CHUNK]
            at = np.flatnonzero(used[a : a + CHUNK])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([_pack(at, *part[at].T)], pa.binary())], ["chunk", "n", "packed"])

    return run


def _merge_chunk(table: pa.Table) -> pa.Table:
    """One part of the tables, summed over tasks; a part has ``CHUNK`` slots."""
    table = table.combine_chunks()
    sums = [np.zeros(CHUNK), np.zeros(CHUNK)]
    for n, packed in zip(table.column("n").to_pylist(), table.column("packed")):
        at, *counts = _unpack(packed.as_py(), n)
        for total, x in zip(sums, counts):
            total[at] += x  # a slot comes once in each
    codes = [np.searchsorted(_LEAST, x, side="right") for x in sums]
    # what each slot tells of its own bits when one at a time is left out
    seen = []
    for zeros, ones, code in ((sums[0] - 1, sums[1], sums[0]), (sums[0], sums[1] - 1, sums[1])):
        left = [np.searchsorted(_LEAST, np.maximum(x, 0), side="right") for x in (zeros, ones)]
        seen.append(np.bincount(left[0] * 64 + left[1], weights=code, minlength=4096))
    used = np.flatnonzero(seen[0] + seen[1])
    lists = [list_array(x, np.array([0, len(used)]), t) for x, t in ((used, pa.int32()), (seen[0][used], pa.float64()), (seen[1][used], pa.float64()))]
    return pa.table([table.column("chunk").slice(0, 1).combine_chunks(), pa.array([(codes[0] * 64 + codes[1]).astype(np.uint16).tobytes()], pa.binary()), *lists], ["chunk", "codes", "code", "zeros", "ones"])


# ---- the mixer

class Model:
    """Tables of codes (the levels of a slot's zeros and ones), what a code says in log odds, and the mixer's starting weights."""

    def __init__(self, vocabulary: Vocabulary, sizes: tuple[int, ...], tables: list[np.ndarray], seen: np.ndarray):
        self.vocabulary, self.sizes, self.tables = vocabulary, sizes, tables
        zeros, ones = np.repeat(_MIDDLE, 64), np.tile(_MIDDLE, 64)
        prior = (ones + _SMOOTH) / (zeros + ones + 2 * _SMOOTH)
        p = (seen[:, 1] + 2 * prior) / (seen.sum(axis=1) + 2)
        p[:, 0] = 0.5  # nothing known
        self.odds = np.log(p / (1 - p)).astype(np.float32)
        level = np.arange(64)
        less = np.where((level > 0) & (level < 9), level - 1, level)
        self.without = np.stack(((less[:, None] * 64 + level).reshape(-1), (level[:, None] * 64 + less).reshape(-1)))  # the code less one zero, less one one
        self.weights = np.full((_SETS, PREDICTORS), 0.3, dtype=np.float32)
        self.refine = np.tile(1 / (1 + np.exp(-(np.arange(_CELLS) / 2 - 12))), _SETS).astype(np.float32)

    def along(self, steps: Steps, weights: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mix along each text: (log10 probability of each step, the texts' last weights, the refining table's zeros and ones).

        All texts start from ``weights`` and take a block of steps at a time, each text
        with weights of its own for each number of predictors that know the context;
        after a block the weights follow the errors made in it.  Nothing looks ahead: a
        bit's chance comes from bits before it.
        """
        n, total = steps.lanes, len(steps.lane)
        size = np.bincount(steps.lane, minlength=n)
        cuts = [0]
        while cuts[-1] < size.max(initial=0):
            cuts.append(cuts[-1] + min(max(STEP, cuts[-1] // 4), MOST_STEP))
        block = np.searchsorted(cuts, np.arange(total) - (np.cumsum(size) - size)[steps.lane], side="right")
        order = np.argsort(block, kind="stable")
        borders = np.cumsum(np.bincount(block, minlength=2))
        bits = _Bits(steps, order, self.sizes)
        lane, kind = steps.lane[order], steps.kind[order]
        odds = np.empty((PREDICTORS, len(bits.bit)), dtype=np.float32)
        shift = bits.bit.astype(np.int64) * 4096 if leave_out else np.uint16(0)
        for k in range(PREDICTORS):
            says = np.concatenate([self.odds[k][w] for w in self.without]) if leave_out else self.odds[k]
            np.take(says, self.tables[k].take(bits.slots(k)) + shift, out=odds[k], mode="clip")
        own = np.tile(weights.T, (1, n))  # for each predictor the texts' sets in turn
        energy = np.full(own.shape, _CALM, dtype=np.float32)
        trust, trust_energy = np.full(n, 0.5, dtype=np.float32), np.full(n, _CALM)
        out, refine = np.zeros(total), np.zeros(_SETS * _CELLS * 2)
        absent = 1 - bits.bit.astype(np.float32)
        sign = 1 - 2 * absent
        sets, apart = own.shape[1], np.arange(PREDICTORS)[:, None] * own.shape[1]
        # the sets of all steps: a text's, for the number of predictors that know the context
        gate = kind * (PREDICTORS + 1)
        for x in odds:
            gate += x[bits.first] != 0
        mine = lane * _SETS + gate
        gate = (gate * _CELLS + 24).astype(np.int32)
        for s, e in zip(borders, borders[1:]):
            if s == e:
                continue
            a, b = int(bits.first[s]), int(bits.ends[e - 1])
            x, bit, first, to = odds[:, a:b], bits.bit[a:b], bits.first[s:e] - a, mine[s:e]
            length = bits.length[s:e]
            part = np.repeat(own.take(to, axis=1), length, axis=1)
            part *= x
            z = part.sum(axis=0)
            np.maximum(z, -12, out=z)
            np.minimum(z, 12, out=z)
            cell = np.rint(z * 2).astype(np.int32)
            cell += np.repeat(gate[s:e], length)
            p = np.negative(z, out=z)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            if leave_out:
                cell *= 2
                cell += bit
                refine += np.bincount(cell, minlength=len(refine))
            else:
                move = np.take(self.refine, cell, mode="clip")
                move -= p
                chance = np.repeat(trust[lane[s:e]], length)
                chance *= move
                chance += p
                np.abs(np.subtract(chance, absent[a:b], out=chance), out=chance)  # of the other value where the bit is 0
                out[s:e] = np.log10(np.multiply.reduceat(chance, first, dtype=np.float64))
                move *= sign[a:b]
                move /= chance
                pull = np.bincount(lane[s:e], weights=np.add.reduceat(move, first), minlength=n)
                trust_energy += pull * pull
                trust = np.clip(trust + _RATE * pull / np.sqrt(trust_energy), 0, 1).astype(np.float32)
            np.subtract(bit, p, out=p)
            x *= p
            pulls = np.add.reduceat(x, first, axis=1)
            pulls = np.bincount((to + apart).ravel(), weights=pulls.ravel(), minlength=own.size).reshape(PREDICTORS, sets).astype(np.float32)
            energy += pulls * pulls
            pulls *= np.float32(_RATE)
            own += pulls / np.sqrt(energy)
        back = np.empty(total)
        back[order] = out
        return back, own.T.reshape(n, _SETS, PREDICTORS), refine.reshape(-1, 2).T


def _learner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One online pass over a bucket of training texts; returns its number, starting weights times bits seen, and the refining table."""
        model = shared.value
        table = model.vocabulary.table()
        weights, refine, mass, bucket = model.weights.astype(np.float64), 0, 0.0, None
        for batch in batches:
            bucket = batch.column("bucket").slice(0, 1) if batch.num_rows else bucket
            data, offsets = texts_of(batch.column("text"))
            for a, b in slices(offsets, BLOCK):
                steps = Steps(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.vocabulary, table)
                _, last, seen = model.along(steps, weights.astype(np.float32), True)
                size = np.bincount(steps.lane, weights=steps.length, minlength=b - a)
                share = np.sqrt(size)
                weights = weights + 0.5 * np.tensordot(share / share.sum(), last - weights, 1)
                refine, mass = refine + seen, mass + float(size.sum())
        if mass:
            flat = np.concatenate((weights.reshape(-1) * mass, refine.reshape(-1), [mass]))
            yield pa.RecordBatch.from_arrays([bucket, list_array(flat, np.array([0, len(flat)]), pa.float64())], ["bucket", "v"])

    return run


def learn(texts: DataFrame, vocabulary: Vocabulary, tokens: int) -> Model:
    """The model of training texts (text), which hold ``tokens`` tokens.

    It depends on the rows alone, not on their partitions: counts are whole numbers,
    and weights are learned in buckets to which rows are dealt by a hash of all their
    columns, in the order of that hash, and averaged in the order of the buckets.  So
    texts should come with an id, or many copies of one text make a long bucket.

    The number of counting tasks follows the size of the texts up to ``COUNTERS``,
    since each sends its part of the tables, whose size is bounded; beyond that
    tasks grow, and so do buckets beyond ``BUCKETS``.
    """
    context = texts.sparkSession.sparkContext
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    sizes = table_bits(tokens, len(vocabulary.counts))
    few = texts.select("text").coalesce(min(max(1, -(-size // COUNTING)), COUNTERS))
    parts = map_texts(few, _bit_counts(context.broadcast(vocabulary), sizes), "chunk int, n int, packed binary")
    merged = parts.groupBy("chunk").applyInArrow(_merge_chunk, "chunk int, codes binary, code array<int>, zeros array<double>, ones array<double>")
    first = np.concatenate(([0], np.cumsum([1 << b for b in sizes])))
    tables, seen = np.zeros(first[-1], dtype=np.uint16), np.zeros((len(sizes), 2, 4096))
    for row in merged.toLocalIterator():  # a fixed number of parts, in turn
        a, b = row.chunk * CHUNK, min((row.chunk + 1) * CHUNK, int(first[-1]))
        tables[a:b] = np.frombuffer(row.codes, dtype=np.uint16)[: b - a]
        k = int(np.searchsorted(first, a, side="right")) - 1
        seen[k][:, np.array(row.code, dtype=np.int64)] += [row.zeros, row.ones]
    model = Model(vocabulary, sizes, [tables[a:b] for a, b in zip(first, first[1:])], seen)
    shared = context.broadcast(model)
    dealt = texts.select(F.xxhash64(*texts.columns).alias("key"), "text").repartition(min(max(1, -(-size // BUCKET)), BUCKETS), "key")
    dealt = dealt.sortWithinPartitions("key", "text").select(F.spark_partition_id().alias("bucket"), "text")
    sums = map_texts(dealt, _learner(shared), "bucket int, v array<double>").select("bucket", F.posexplode("v").alias("at", "x"))
    turns = F.array_sort(F.collect_list(F.struct("bucket", "x")))  # a value a bucket
    sums = sums.groupBy("at").agg(F.aggregate(turns, F.lit(0.0), lambda t, r: t + r["x"]).alias("x"))
    flat = np.array([r.x for r in sums.orderBy("at").collect()])  # one value a weight
    if len(flat):
        n = model.weights.size
        counts = flat[n:-1].reshape(2, -1)
        refine = (counts[1] + model.refine * 20) / (counts.sum(axis=0) + 20)
        model.weights = (flat[:n] / flat[-1]).reshape(model.weights.shape).astype(np.float32)
        model.refine = np.clip(refine, 1e-6, 1 - 1e-6).astype(np.float32)
    return model


def _texts(mixed, total: float, kinds: float, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = mixed.value
        vocabulary, table = model.vocabulary, model.vocabulary.table()
        base = np.log10((vocabulary.counts + 0.5) / (total + 0.5 * (kinds + 1)))
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in slices(offsets, BLOCK):
                n, at = b - a, offsets[a : b + 1] - offsets[a]
                steps = Steps(data[offsets[a] : offsets[b]], at, vocabulary, table)
                score = np.bincount(steps.lane, weights=model.along(steps, model.weights, False)[0], minlength=n)
                hit = steps.symbol >= 0
                row, known = steps.row[hit], steps.symbol[hit]
                misses = list_array(steps.hash[~hit].view(np.int64), grouped(steps.row[~hit], n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(a, n) for c in ("rid", "doc_id", "held_out")], pa.array(np.diff(at)), pa.array(np.bincount(steps.row, minlength=n) + 1),
                        pa.array(np.bincount(row, minlength=n) + (1 if ends else 0)),
                        pa.array(np.bincount(row, weights=base[known], minlength=n) + np.log10((ends + 0.5) / (total + 0.5 * (kinds + 1)))),
                        pa.array(score), misses,
                    ],
                    ["rid", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score", "misses"],
                )

    return run


def score_documents(documents: DataFrame, folds: int = 5, held: int = 1, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``held``; a
    null doc_id counts as the empty text there.  A null text is empty: its one token
    is the end.  ``score`` is the log10 probability of all of the text's tokens.
    bits_per_byte is null for empty texts.  Rows may repeat; other columns are not
    read.  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    docs = documents.select("doc_id", (fold == held).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = map_texts(docs.select("text", F.col("held_out").cast("int").alias("class")), _count_words, "h long, word binary, n long")
    counted = materialise(counted.groupBy("h", "word").agg(F.sum("n").alias("n")).drop("word"), "words")
    total, kinds = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    training = docs.where(~F.col("held_out")).select("doc_id", "text")
    ends = training.count()
    best = most_frequent(counted.where("n > 1"), "n", frequent).toArrow()  # at most ``frequent`` rows
    counts = best.column("n").to_numpy()
    vocabulary = Vocabulary(best.column("h").to_numpy().view(np.uint64), counts, ends, total - int(counts.sum()))
    total, kinds = total + ends, kinds + (1 if ends else 0)
    mixed = spark.sparkContext.broadcast(learn(training, vocabulary, total))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = map_texts(
        docs.withColumn("rid", F.monotonically_increasing_id()), _texts(mixed, total, kinds, ends),
        f"rid long, doc_id {id_type}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, misses array<long>",
    )
    rows = materialise(rows, "rows")
    rare = rows.select("rid", F.explode("misses").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("times")).join(counted, "h")
    base = F.log10((F.col("n") + 0.5) / (total + 0.5 * (kinds + 1)))
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * base).alias("b"))
    plus = lambda a, b: a + F.coalesce(F.col(b), F.lit(0))
    out = rows.join(rare, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", plus(F.col("n_known"), "k").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus(F.col("base_score"), "b").alias("base_score"), "score", (-F.col("score") / float(np.log10(2.0)) / F.nullif("n_bytes", F.lit(0))).alias("bits_per_byte"),
    )
