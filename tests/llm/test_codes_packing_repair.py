"""Vector codes, packed sequences and conversation repair against brute force; and odd rows."""

import bisect
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chainloom.llm import codebooks, packing, repair

from .conftest import CLASHES, documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


# ---- vector codes

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Every vector against every entry, in Python integers."""
    kept = [(i, [math.floor(256 * np.float32(x).item()) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}
    w = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * w : (p + 1) * w]
    books = [[list(cut(q, p)) for _, q, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for _, q, _ in kept:
                held[near(cut(q, p), book)[1]].append(cut(q, p))
            for k, xs in held.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, [near(cut(q, p), books[p]) for p in range(parts)], lab) for i, q, lab in kept]
    errors = [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), lab) for i, f, lab in found]
    total = Counter()
    for *_, e, lab in errors:
        total[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, total[lab], digest) for i, c, e, lab in errors)


def vectors(n, seed=0, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.15, (9, dims))
    out = [(int(i), (centres[i % 9] + rng.normal(0, 0.05, dims)).astype(np.float32).tolist(), int(i % 5) if i % 11 else None) for i in rng.permutation(n)]
    out += [(n + k, out[0][1], 1) for k in range(n // 3)]  # one very common vector
    return out


def coded(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in (*CLASHES, "q", "code", "sums", "error")})
    return Counter(tuple(r) for r in codebooks.compress(df, **more).collect())


@pytest.mark.parametrize("n", [1, 40, 300])
def test_codes(spark, n):
    rows = vectors(n)
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 1), (901, [0.1] * 63 + [None], 1), (902, [nan] * 64, 1), (903, [0.5] * 63 + [-inf], 0), (904, [], 2), (905, [0.1] * 7, 2), (906, [0.1] * 32, 2)]
    assert coded(spark, rows + odd) == plain_codes(rows)


def test_codes_of_ties_and_repeats(spark):
    """Coarse components make many equal distances; vec_ids repeat or are null."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 60)) if k % 7 else None, (rng.integers(-2, 3, 32) / 256).tolist(), None) for k in range(200)]
    assert coded(spark, rows, entries=20) == plain_codes(rows, entries=20)


def test_no_vectors(spark):
    assert coded(spark, [(1, None, 1)]) == Counter() == coded(spark, [])


@given(st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=12), st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=12), st.randoms())
@settings(max_examples=200, deadline=None)
def test_exponion_is_exact(entries, points, rng):
    book = codebooks.Codebook(np.array(entries, dtype=np.int64))
    x = np.array(points, dtype=np.int64)
    start = np.array([rng.randrange(len(entries)) for _ in points])
    gaps = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    best, least = book.nearest(x, start)
    assert (best == gaps.argmin(axis=1)).all() and (least == gaps.min(axis=1)).all()


def test_decode():
    books = [np.array([[1, 2], [3, 4]]), np.array([[5, 6], [7, 8]])]
    assert codebooks.decode("0001", books).tolist() == [1, 2, 7, 8]


# ---- packed sequences

def plain_ids(texts):
    model = Tokenizer.from_file(WORDS)
    return [np.array([*e.ids, 1], "<u4") for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(texts, rows, capacity):
    ids = plain_ids(texts)
    want = Counter()
    for i, x in enumerate(ids):
        for p in range(-(-len(x) // capacity)):
            part = x[p * capacity : (p + 1) * capacity]
            want[i, p, p * capacity, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) <= capacity
    return len(held), best_fit([n for *_, n, _ in want.elements()], capacity)


def best_fit(sizes, capacity):
    """Sequences of best fit, longest first, with all pieces in one place."""
    gaps, made = [], 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        made += k == len(gaps)
        rest = (gaps.pop(k) if k < len(gaps) else capacity) - s
        if rest:
            bisect.insort(gaps, rest)
    return made


UNITS = ["it's", "we'll", "don't.", "x''s", "-'s", "a|b", "<|endoftext|>", "x<|startoftext|>y", "İstanbul", "ŒUVRE", "Straße", "été", "́", "≠", "12,345.6", "½", "中文字", "नमस्ते", "क़", "क़x", "a b", "\x01\x02", "😀!", "ﬁn", "ΣΑΣ", "[[w]]", " ", "'", "''", "…", "A1b2"]


@given(st.lists(st.lists(st.sampled_from([*UNITS, " ", "\n", "\t", "the", "Word"]), max_size=9).map("".join), min_size=1, max_size=8), st.lists(st.text(max_size=12), max_size=4))
@settings(max_examples=100, deadline=None)
def test_word_units_end_words(mixed, wild):
    """Units encoded apart give the ids of whole texts."""
    import pyarrow as pa

    texts = mixed + wild
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    (out,) = packing._pieces(WORDS, 1 << 20, 1, True, pa.int64())(iter([batch]))
    assert out.column("ids").to_pylist() == [x.tobytes() for x in plain_ids(texts)]


def test_packing(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(UNITS + [f"w{i}" for i in range(300)], k=int(rng.paretovariate(1.1) * 4))) for _ in range(900)]
    texts += [texts[0]] * 400 + [None, "", " \n"]
    rows = packing.pack_documents(documents(spark, texts), WORDS, 64, shard_tokens=1 << 30).collect()
    used, least = check_packing(texts, rows, 64)
    assert used <= 1.02 * least + 1
    rows = packing.pack_documents(documents(spark, texts).repartition(7), WORDS, 64, shard_tokens=9000).collect()
    shards = Counter(r.sequence_id >> 32 for r in rows)
    used, least = check_packing(texts, rows, 64)
    assert len(shards) > 2 and max(shards.values()) - min(shards.values()) <= 1 and used <= 1.02 * least + len(shards)
    again = packing.pack_documents(documents(spark, texts).repartition(3, "n_chars"), WORDS, 64, shard_tokens=9000).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_packing_of_odd_rows(spark, odd, empty):
    """Null and repeated doc_ids, null, empty and very long texts, clashing columns; an empty table."""
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows = packing.pack_documents(odd, WORDS).collect()
    want = Counter()
    for (i, _), x in zip(texts, plain_ids([t for _, t in texts])):
        want.update((i, p, min(4096, len(x) - p * 4096)) for p in range(-(-len(x) // 4096)))
    assert Counter((r.doc_id, r.piece, r.length) for r in rows) == want
    assert packing.pack_documents(empty, WORDS).count() == 0 == packing.packed_sequences(empty, WORDS).count()


def test_packing_of_texts_longer_than_a_slice(spark):
    texts = ["short", "word " * 300_000, "y" * 1_100_000, " " * 1_200_000]
    rows = packing.pack_documents(documents(spark, texts), WORDS).collect()
    assert check_packing(texts, rows, 4096)[0] == len({r.sequence_id for r in rows})


def test_sequences_hold_the_ids(spark):
    texts = ["one two three", "x " * 100, None, "four", "five's six", "y" * 50]
    ids, rows = plain_ids(texts), packing.packed_sequences(documents(spark, texts), WORDS, 32).collect()
    for r in rows:
        whole = np.frombuffer(bytes(r.ids), "<u4")
        assert len(whole) == sum(p.length for p in r.pieces) <= 32
        for p in r.pieces:
            assert (whole[p.offset : p.offset + p.length] == ids[p.doc_id][p.start : p.start + p.length]).all()
    assert sum(p.length for r in rows for p in r.pieces) == sum(map(len, ids))


@given(st.lists(st.integers(1, 12), max_size=60))
def test_least_sum_of_squares(sizes):
    """Each place is as good as the best of all gaps and a new sequence."""
    state, gaps = packing.OpenSequences(12), {}
    cost = lambda gs: sum(n * n for n in Counter(g for g in gs if g).values())
    for size in sizes:
        best = min([cost([*gaps.values(), 12 - size])] + [cost([*(g for k, g in gaps.items() if k != q), h - size]) for q, h in gaps.items() if h >= size])
        sequence, at = state.place(size)
        assert at == 12 - gaps.get(sequence, 12)
        gaps[sequence] = gaps.get(sequence, 12) - size
        assert cost(gaps.values()) == best


# ---- conversations

def plain_repair(rows):
    """Least (cost, audit) by search over all edit strings; rows of one conversation as (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, p, last, out = heapq.heappop(heap)
        if p == len(rows) and last in ("", "a"):
            break
        if (p, last) in done:
            continue
        done.add((p, last))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if p < len(rows):
            _, role, text = rows[p]
            heapq.heappush(heap, (cost + 2, audit + "D", p + 1, last, out))
            if faults[p] not in ("blank", "duplicate"):
                extra = 5 * (faults[p] == "truncated")
                if role[:1] and role[:1] in legal:
                    heapq.heappush(heap, (cost + extra, audit + "K", p + 1, role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in legal:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", p + 1, new[0], (*out, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in legal and audit.count("I") < len(rows) + 2:
                heapq.heappush(heap, (cost + 5, audit + "I", p, new[0], (*out, new + ":")))
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(x not in ("su", "ua", "au") for x in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    return out


def plain_report(rows, damaged):
    by = defaultdict(list)
    for conv, *rest in damaged:
        by[conv].append(tuple(rest))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64])
    return {conv: plain_repair(sorted(by[conv], key=order)) for conv in {r[0] for r in rows}}


def report(spark, rows, damaged=None):
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in (*CLASHES, "rid", "place", "act", "line", "fault", "fate")})
    hurt = repair.damage(df) if damaged is None else df
    got = repair.repair_report(df, hurt).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def turns(rng, conv, n):
    out = []
    for t in range(n):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
        role = rng.choice(["system", "tool", "", None, "umbrella"]) if rng.random() < 0.12 else role
        text = rng.choice(["", " ", None, "no end", "same."]) if rng.random() < 0.2 else f"text {conv} {t}{rng.choice(['.', '!', '?', '. '])}"
        out.append((conv, rng.choice([t, t, t, t + 3, None]), role, text))
    return out


def test_repair(spark):
    rng = random.Random(7)
    rows = [r for conv in range(300) for r in turns(rng, conv if conv else None, rng.randint(1, 9))]
    rng.shuffle(rows)
    assert report(spark, rows) == plain_report(rows, plain_damage(rows))
    assert report(spark, rows, rows) == plain_report(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(8)
    rows = turns(rng, 5, 3000) + turns(rng, 6, 4) + [(7, 1, "user", "same.")] * 500 + [(8, t, "user", "same.") for t in range(500)]
    rows += [(9, 0, "user", "long " * 100_000 + ".")]
    assert report(spark, rows) == plain_report(rows, plain_damage(rows))


def test_no_conversations(spark):
    assert report(spark, []) == {}
    lost = next((c, t) for c in range(100) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert report(spark, [(*lost, "user", "gone.")]) == {lost[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@given(st.lists(st.integers(0, 11), max_size=7))
@settings(max_examples=300, deadline=None)
def test_least_audit(codes):
    """All edit strings of short conversations, tried one by one."""
    best = (10**9, "")
    roles = {0: "", 1: "s", 2: "u", 3: "a"}

    def go(p, word, cost, audit, inserted):
        nonlocal best
        if cost > best[0] or not re.fullmatch(r"(s|s?(ua)*u?)", word):
            return
        if p == len(codes) and re.fullmatch(r"(s?(ua)+)?", word):
            best = min(best, (cost, audit))
        if inserted < 2:
            for c in "ua":
                go(p, word + c, cost + 5, audit + "I", inserted + 1)
        if p < len(codes):
            role, fault = divmod(codes[p], 3)
            extra = 5 * (fault == 2)
            go(p + 1, word, cost + 2, audit + "D", inserted)
            if fault != 1:
                if role:
                    go(p + 1, word + roles[role], cost + extra, audit + "K", inserted)
                for c in "ua":
                    go(p + 1, word + c, cost + 1 + extra, audit + "R", inserted)

    go(0, "", 0, "", 0)
    cost, letters, last = repair.repair_codes(bytes(codes))
    assert (cost, "".join(letters) + last) == best
