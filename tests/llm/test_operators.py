"""The ten operators against brute force, exact round trips and held-out accuracy; and odd rows."""

import base64
import hashlib
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

from chainloom.llm import components, dac, decontam, hilbert, mixing, mixlm, naming, neardup, ranking, textkernel, tokencount, toxicity, units, warc
from chainloom.llm.ranking import global_rank

from .conftest import documents

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VOCAB = [f"w{i}" for i in range(400)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n):
    return " ".join(rng.choices(VOCAB, k=n))


def near_corpus(n=60, seed=1):
    """Texts, copies, chains of small edits and a passage that many share."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    base = prose(rng, 100).split()
    for k in range(40):
        edited = list(base)
        edited[rng.randrange(100)] = f"new{k}"
        out.append(" ".join(edited))
    passage = prose(rng, 60)
    out += [passage + " " + prose(rng, rng.randint(4, 40)) for _ in range(40)]
    step = prose(rng, 90).split()
    for k in range(12):
        step[7 * k] = f"step{k}"
        out.append(" ".join(step))
    return out + out[:20]


def sets_of(texts, width):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def component_ids(ids, sets, threshold):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= round(threshold * 100) * (len(sets[a]) + len(sets[b]) - i):
                p, q = root(ids[a]), root(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


# ---- kernels

@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=60)
def test_words_kernel(texts):
    import pyarrow as pa

    data, offsets = textkernel.texts_of(pa.array(texts, pa.string()))
    starts, ends, row = textkernel.words(textkernel.lower_ascii(data), offsets)
    low = textkernel.lower_ascii(data).tobytes()
    got = [[] for _ in texts]
    for s, e, r in zip(starts, ends, row):
        got[r].append(low[s:e].decode())
    assert got == [words_of(t) for t in texts]
    h = textkernel.span_hashes(np.frombuffer(low, np.uint8), starts, ends)
    seen = {}
    for s, e, x in zip(starts, ends, h):
        assert seen.setdefault(low[s:e], x) == x
    assert len(set(seen.values())) == len(seen)


def thue_morse(n):
    """Two unlike texts of 2**n letters that a polynomial hash modulo a power of two can't tell apart."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_patterned_texts_do_not_collide(spark):
    """Thue-Morse words of 1024 to 8192 letters give exact results in all operators that name units by hash."""
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [f"{x} {y} {x}" for n in (10, 11, 12, 13) for x, y in [thue_morse(n), thue_morse(n)[::-1]]] + [x for n in (10, 11, 12, 13) for x in thue_morse(n)]
    df = documents(spark, texts)
    bpe, piece = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    crc = {r.doc_id: r.ids_crc32 for r in dac.token_ids(df, BPE).collect()}
    assert all(crc[i] == zlib.crc32(np.array([*bpe.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, PIECE).collect()} == {i: len(piece.encode(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {i: i for i in range(len(texts))}
    train = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in words_of(t))
    assert all(r.n_known == 1 + sum(train[w] > 0 for w in words_of(texts[r.doc_id])) for r in mixlm.score_documents(df).collect())
    assert all(r.kept for r in naming.exact_duplicates(df, 1024).collect())


def test_caches_check_units():
    """Units that share the first hash are told apart by the second."""
    cache = units.UnitCache(lambda us: (np.array([u[0] for u in us], dtype=np.int32), np.ones(len(us), dtype=np.int32)), limit=4)
    raw, starts = b"abcdefab", np.arange(8)
    h, check = np.zeros(8, dtype=np.uint64), np.frombuffer(raw, np.uint8).astype(np.uint64)
    first, size = cache.look_up(h, check, raw, starts, starts + 1)
    assert bytes(cache.pool[first].astype(np.uint8)) == raw and (size == 1).all()


@given(st.lists(st.binary(max_size=90), min_size=2, max_size=8), st.integers(0, 3))
@settings(max_examples=80)
def test_span_hashes(parts, salt):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    starts = ends - [len(x) for x in parts]
    h = textkernel.span_hashes(data, starts, ends, salt)
    assert len(set(h.tolist())) == len(set(parts))
    alone = [textkernel.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), salt)[0] for x in parts]
    assert h.tolist() == [int(x) for x in alone]
    pairs = textkernel.span_pairs(data, starts, ends)
    assert len(set(pairs[1].tolist())) == len(set(parts)) and (salt or (pairs[0] == h).all())


def test_hash_table():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    table = textkernel.HashTable(keys)
    assert (keys[table.find(keys)] == keys).all() and (table.find(keys + np.uint64(1)) == -1).sum() > 4990
    assert (textkernel.HashTable(np.zeros(0, np.uint64)).find(keys[:3]) == -1).all()


def test_rank_and_components(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r.rank for r in global_rank(df, ["v"]).collect())
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(links).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 150: 100}


# ---- 1 sharding

def test_hilbert_curve_is_one_path():
    side = np.arange(8)
    for dims in (2, 3):
        cells = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert.hilbert_index(cells, 3)
        assert sorted(index) == list(range(8**dims))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    texts = [prose(random.Random(i), i % 50) for i in range(103)]
    rows = hilbert.shard_documents(documents(spark, texts), 8).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert sorted(len(v) for v in per.values()) == [12] + [13] * 7
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in per.values())
    runs = [sorted(v, key=lambda r: r.slot) for _, v in sorted(per.items())]
    curve = [r.curve for v in runs for r in v]
    assert curve == sorted(curve)


def test_shard_files(spark, tmp_path):
    """Every row is written, those without doc_id and repeated ones too, in shards of equal length."""
    rows = [(i % 90 if i % 7 else None, prose(random.Random(i), i % 40) if i % 11 else None, "en" if i % 3 else None, f"s{i % 4}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long").withColumn("curve", F.lit("clash"))
    zones = hilbert.write_shards(df, f"{tmp_path}/shards", ["doc_id", "lang"], 4, 2000).collect()
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter(tuple(r)[:6] for r in back.select(*df.columns).collect()) == Counter(tuple(r) for r in df.collect())
    assert sorted(r.rows for r in zones) == [75] * 4
    assert hilbert.write_shards(df.limit(0), f"{tmp_path}/none", ["doc_id"]).count() == 0


# ---- 2 mixing

def mix_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        level = left / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 200)), rng.choice(["a", "b", "c", "dd", None]) if i % 9 else "tiny") for i in range(300)]
    rows += [(1000, "x y", "e"), (1001, None, "null text")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want = mix_by_hand(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK for s in want)
    quota = {(r.source, r.shard): r.blocks for r in mixing.shard_quotas(mixing.targets(mixing.sized(df))).collect()}
    for s in want:  # each shard takes its quota of blocks; what is no whole block or above the cap falls to the last
        per = [sum(r.shares[k] for r in got if r.source == s) for k in range(mixing.SHARDS)]
        assert all(p == quota[s, k] * mixing.BLOCK or sum(per[: k + 1]) == 3 * sizes[s] for k, p in enumerate(per))
    assert all(sum(r.shares) == r.taken and min(r.shares) >= 0 for r in got)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect())


@pytest.mark.parametrize("blocks", [0, 1, 7, 50, 333])
def test_quotas_are_highest_quotients(spark, blocks):
    sizes = spark.createDataFrame([(s, n) for s, n in (("a", 500), ("b", 300), ("c", 1), ("d", 170), (None, 90))], "source string, size long")
    table = mixing.targets(sizes)
    target = {r.source: r.target for r in table.collect()}
    seats = sorted(((-t / (2 * k - 1), s is None, s or "", k) for s, t in target.items() for k in range(1, blocks + 2)))[:blocks]
    want = Counter("" if none else s for _, none, s, _ in seats)
    got = {r.source or "": r.blocks for r in mixing.quotas(table, F.lit(blocks)).collect()}
    assert {s: n for s, n in got.items() if n} == dict(want)
    shards = mixing.shard_quotas(table, 4, 32).groupBy("shard").agg(F.sum("blocks").alias("n"), F.min("blocks").alias("least")).collect()
    assert all(r.least >= 0 for r in shards) and sum(r.n for r in shards) == round(1061 / 32)


# ---- 3 toxicity

def toxic_corpus(n=1500, seed=2):
    rng = random.Random(seed)
    bad = ["foulo", "nastix", "vilex", "grossu", "hatefu"]
    texts, labels = [], []
    for i in range(n):
        w = rng.choices(VOCAB, k=rng.randint(3, 60))
        y = i % 7 == 0
        if y:
            for b in rng.sample(bad, 2) + [rng.choice(["zzkrat"]) + rng.choice("abcdef")]:
                w.insert(rng.randrange(len(w)), b)
        texts.append(" ".join(w).capitalize() + ".")
        labels.append((i, None if i % 11 == 0 else 1, int(y)))
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus()
    df = spark.createDataFrame([x for x in labels if x[0] % 2 == 0 or x[0] < 900], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(documents(spark, texts), df).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98 and all((r.score >= 0.3) == r.predicted for r in rows)
    assert np.mean([r.predicted for r in held if truth[r.doc_id]]) > 0.95


def test_label_model_finds_accuracies_and_correlations(spark):
    """Voters of known accuracy, one of them copied twice: rates come out, copies hang together, and do not count again."""
    rng = np.random.default_rng(7)
    n, toxic = 6000, 0.2
    y = rng.random(n) < toxic
    rate = np.array([[0.02, 0.03, 0.01, 0.05, 0.02, 0.04, 0.03, 0.02], [0.6, 0.5, 0.4, 0.7, 0.5, 0.6, 0.4, 0.5]])  # clean, toxic
    fires = rng.random((n, 8)) < rate[y.astype(int)]
    fires = np.column_stack((fires, fires[:, 0], fires[:, 0]))
    table = spark.createDataFrame([([int(k) for k in np.flatnonzero(f)], -1, 1.0) for f in fires], "features array<int>, known long, n double")
    start = np.vstack((np.full(10, 12.0), np.full(10, 2.0)))  # what a small, rough sample says: toxic and clean rows
    model = toxicity._label_model(table, start, (30, 60), 10)
    assert np.allclose(model.fires[:, :8], rate, atol=0.05) and model.prior == pytest.approx(toxic, abs=0.02)
    linked = {tuple(sorted((k, int(p)))) for k, p in enumerate(model.parent) if p >= 0}
    assert len(linked & {(0, 8), (0, 9), (8, 9)}) == 2  # the copies are joined in the tree
    q = model.posterior(np.array([0, 8, 9]), np.array([0, 0, 0]), np.array([-1]))[0]
    logit = np.log(toxic / (1 - toxic)) + np.log(rate[1, 0] / rate[0, 0]) + np.log((1 - rate[1, 1:]) / (1 - rate[0, 1:])).sum()
    assert q == pytest.approx(1 / (1 + np.exp(-logit)), abs=0.05)  # as if the voter stood alone


def test_rare_vocabulary(spark):
    """Toxic rows of a second vocabulary, 20 among 3000, are found beside 300 of the first; no weight is negative."""
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(3000):
        kind = "a" if i % 10 == 0 else "b" if i % 150 == 7 else ""
        w = [f"{'q' if kind == 'b' else 'w'}{rng.randrange(500)}" for _ in range(40)]
        for k in range({"a": 3, "b": 4, "": 0}[kind]):
            w.insert(rng.randrange(len(w)), f"bad{rng.randrange(6)}" if kind == "a" else f"xarr{rng.randrange(40)}o")
        texts.append(" ".join(w))
        labels.append((i, 1, int(kind != "")))
    weights, fit = [], toxicity._fit
    toxicity._fit = lambda *a: weights.append(fit(*a)) or weights[-1]
    try:
        rows = toxicity.toxicity_scores(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        toxicity._fit = fit
    for first in (True, False):
        held = [r.predicted for r in rows if r.held_out and labels[r.doc_id][2] and (r.doc_id % 10 == 0) == first]
        assert np.mean(held) >= 0.9
    assert not any(r.predicted for r in rows if not labels[r.doc_id][2]) and (weights[0][0] >= 0).all()


def test_spanning_tree():
    gain = np.zeros((4, 4))
    for a, b, g in ((0, 1, 5), (1, 2, 3), (0, 2, 4), (2, 3, 0)):
        gain[a, b] = gain[b, a] = g
    assert toxicity.spanning_tree(gain).tolist() == [-1, 0, 0, -1] and len(toxicity.spanning_tree(np.zeros((0, 0)))) == 0


def test_toxicity_without_labels(spark, empty):
    labels = spark.createDataFrame([(1, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(documents(spark, ["a", None]), labels).collect()
    assert [r.predicted for r in rows] == [0, 0] and all(0 <= r.score < 0.3 for r in rows)
    assert toxicity.toxicity_scores(empty, labels).count() == 0


# ---- 4 WARC

def test_warc(spark):
    rng = random.Random(3)
    html = [prose(rng, 40) for _ in range(50)]
    rows = [(i, f"http://x/{i}\r\n y", rng.choice(html)) for i in range(200)] + [(500, None, None), (501, "u", ""), (7, "again", html[0]), (7, "again", html[0]), (None, "n", html[1]), (None, "n", "only here")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    manifest = warc.write_archives(df, roll_bytes=4000)
    assert manifest.count() > 3
    got = warc.read_archives(manifest).collect()
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(best.get(h or "", -1), p)
    want, seen = Counter(), set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        h = h or ""
        target = best.get(h)
        first = target == p and (p, h) not in seen
        seen.add((p, h))
        want[(p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first else "revisit", None if first else target)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    again = [[tuple(r) for r in warc.write_archives(df.repartition(n), roll_bytes=9000, run_bytes=8000).select("shard", "roll", "sha1").orderBy("shard", "roll").collect()] for n in (3, 7)]
    assert again[0] == again[1] and len({x[0] for x in again[0]}) > 3
    known = spark.read.parquet(manifest.first().path.rpartition("/")[0] + "/manifest")
    assert sorted(r.path for r in known.collect()) == sorted(r.path for r in manifest.collect())
    long = warc.archive_round_trip(spark.createDataFrame([(1, None, "x y " * 1_500_000), (2, None, "x y " * 1_500_000)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in long) == [(1, 6_000_000, "revisit"), (2, 6_000_000, "response")]
    small = warc.archive_round_trip(df, min_bytes=10**6).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_words_are_counted_without_listing_them(spark):
    texts = ["", " ", "\t\n", " a ", "a\x0bb\x0cc\r", "ünï – x", "a\u00a0b", "\x00 \x1f", "$1 \\ x", None, "\u3000", "a  b\n\nc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [len(words_of(t)) if t else 0 for t in texts]
    assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()


# ---- 5 decontamination

def leaks_by_hand(texts, items, width=5, threshold=0.8):
    out = {}
    for d, t in enumerate(texts):
        w = words_of(t)
        for i, item in enumerate(items):
            iw = words_of(item)
            if not iw or not w:
                continue
            k = min(width, len(iw))
            ci = Counter(tuple(iw[q : q + k]) for q in range(len(iw) - k + 1))
            span = min(len(iw), len(w)) - k + 1
            best = (0, 0)
            for s in range(max(0, len(w) - len(iw)) + 1):
                cw = Counter(tuple(w[p : p + k]) for p in range(s, s + span))
                both = sum((cw & ci).values())
                best = max(best, (both / (sum(ci.values()) + max(span, 0) - both), -s))
            if best[0] >= threshold:
                out[d, i] = (-best[1], round(best[0], 6))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    items = [prose(rng, rng.randint(12, 50)) for _ in range(12)] + ["two words", "", "a a a a a a a a"]
    texts = [prose(rng, rng.randint(5, 150)) for _ in range(80)]
    for k in range(40):
        w = items[k % 12].split()
        if k % 4 == 1:
            w[rng.randrange(len(w))] = "changed"
        if k % 4 == 2:
            w.insert(rng.randrange(len(w)), "added")
        if k % 4 == 3:
            w = w[: int(len(w) * 0.9)]
        texts[k] = prose(rng, rng.randint(0, 30)) + " " + " ".join(w).upper() + "\n" + prose(rng, rng.randint(0, 30))
    texts += [items[0] + " " + items[0], "here two words are", "a a a a a a a a a a", items[3][: len(items[3]) // 2]]
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None), (0, items[0])], "item_id long, text string").withColumn("size", F.lit("clash"))
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontam.contaminated(documents(spark, texts), bench).collect()}
    assert got == leaks_by_hand(texts, items) and len(got) > 12


def test_every_item_text_is_searched(spark):
    """Items without item_id and all texts of a repeated item_id are found."""
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 20) for _ in range(4))
    bench = spark.createDataFrame([(None, a), (None, b), (1, c), (1, d)], "item_id long, text string")
    got = decontam.leaks(documents(spark, [a, b, c, d, d + " more " + c[:40]]), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in got) == [(0, None, 0, 1.0), (1, None, 0, 1.0), (2, 1, 0, 1.0), (3, 1, 0, 1.0), (4, 1, 0, 1.0)]


@pytest.mark.parametrize("m", [(7, 20, 55), (12, 100)])
def test_every_window_is_fingerprinted(spark, m):
    """The windows come from the fingerprints of all windows, in narrow and wide lanes, over borders of pieces and in short texts."""
    rng = random.Random(sum(m))
    pool = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    texts = {t: [rng.choice(pool) for _ in range(n)] for t, n in enumerate((1, 6, 19, 54, 90, 300, 700))}
    items = [(k, size + 4, size, rng.getrandbits(64) - (1 << 63), rng.sample(pool, 9)) for k, size in enumerate([*m, m[0], m[-1]])]
    want, all_of_them = set(), 0
    for t, h in texts.items():
        for _, size, places, fp, own in items:
            span = min(places, len(h))
            need = math.ceil(0.8 / 1.8 * (places + span) - 1e-9)
            for p in range(len(h) - span + 1 if need <= span else 0):
                votes = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[p : p + span]) > span)
                all_of_them += 1
                if ((votes ^ fp) & (1 << 64) - 1).bit_count() <= 30 and set(h[p : p + span - need + 1]) & set(own):
                    want.add((t, size, span, p))
    prints = spark.createDataFrame([i[:4] for i in items], "key long, size int, m int, fp long")
    grams = spark.createDataFrame([(i[0], s) for i in items for s in i[4]], "key long, s long")
    got = decontam._near_windows(spark.createDataFrame(list(texts.items()), "tag long, h array<long>"), prints, grams, 0.8, 30)
    assert {tuple(r) for r in got.select("tag", "size", "span", "start").collect()} == want and 20 < len(want) < all_of_them / 2


def test_sums_of_votes_may_run_over(spark):
    """Sums along a long text exceed a lane's top; each window is fingerprinted once, not once more for every filter, nor again for each item."""
    full = [-1] * 700 + [5] * 20
    prints = spark.createDataFrame([(k, 24, 20, fp) for k, fp in enumerate([-1, 5, *range(1 << 40, (1 << 40) + 9)])], "key long, size int, m int, fp long")
    grams = spark.createDataFrame([(0, -1), (1, 5), *[(k, 7) for k in range(2, 11)]], "key long, s long")
    got = decontam._near_windows(spark.createDataFrame([(1, full)], "tag long, h array<long>"), prints, grams, 0.8, 0)
    assert sorted(r.start for r in got.collect()) == [*range(690), 698, 699, 700]  # below 690 most of 20 vote for all bits; from 698 one of the first three is the other item's
    assert got._jdf.queryExecution().optimizedPlan().toString().count("shiftrightunsigned") == 7
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_windows_bring_their_fingerprints(spark):
    """Each window comes with its fingerprint and shingles, so texts are not read again for them."""
    rng = random.Random(3)
    h = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    prints = spark.createDataFrame([(0, 24, 20, 0)], "key long, size int, m int, fp long")
    grams = spark.createDataFrame([(0, s) for s in h], "key long, s long")
    got = decontam._near_windows(spark.createDataFrame([(1, h)], "tag long, h array<long>"), prints, grams, 0.8, 64).collect()
    assert sorted(r.start for r in got) == [*range(41)]
    for r in got:
        part = h[r.start : r.start + 20]
        assert r.inside == part and r.fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > 20)


def test_hamming_blocks_guarantee():
    rng = random.Random(0)
    cuts = [64 * i // (decontam.RADIUS + 1) for i in range(decontam.RADIUS + 2)]
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontam.RADIUS):
            y ^= 1 << b
        assert any((x ^ y) >> a & ((1 << (b - a)) - 1) == 0 for a, b in zip(cuts, cuts[1:]))


# ---- 6 token files

TRICKY = ["Don't stop, it's 3.14  ok\n\nNew line\n A", "a  b 　c", "x<|endoftext|>y <|endoftext|>", "tab\tand\r\nreturn ", "   lead", "ünï—cödé’s", "it 's (we'll) \"q\"", "a\n\n b", "\n", " ", "1,000's", "end.\nStart-up"]


def test_token_files(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    texts = TRICKY + [prose(random.Random(i), 30) for i in range(40)] + ["", None]
    rows = sorted(dac.token_ids(documents(spark, texts), BPE, roll_ids=300).collect())
    start = 0
    for r, t in zip(rows, texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    many = documents(spark, [prose(random.Random(i), 30) for i in range(300)])
    again = [[(r.shard, r.roll, r.crc32) for r in dac.write_token_files(many.repartition(n), BPE, roll_ids=900, file_bytes=3000).orderBy("shard", "roll").collect()] for n in (2, 7)]
    assert again[0] == again[1] and len({x[0] for x in again[0]}) > 3


@given(st.lists(st.text("ab 'sT.,|<\n\t\r é1", max_size=14), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_units_end_tokens(texts):
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    model, piece = test_units_end_tokens.__dict__.setdefault("m", (Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE)))
    data, offsets = textkernel.texts_of(pa.array(texts, pa.string()))
    raw = data.tobytes()
    for k, t in enumerate(texts):
        starts = [int(s) for s in units.byte_bpe_units(data, offsets) if offsets[k] <= s < offsets[k + 1]] + [int(offsets[k + 1])]
        ids = [i for a, b in zip(starts, starts[1:]) for i in model.encode(raw[a:b].decode(), add_special_tokens=False).ids]
        assert ids == model.encode(t, add_special_tokens=False).ids
    got = tokencount._units(data, offsets)
    sizes = tokencount._piece_model(PIECE).look_up(got[4], got[5], got[0].tobytes(), got[2], got[3])[1] if len(got[2]) else []
    upto = np.concatenate(([0], np.cumsum(sizes)))
    n = np.diff(upto[np.searchsorted(got[2], got[1])]) * (np.diff(offsets) > 0)
    assert n.tolist() == [len(piece.encode(t)) for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=60), st.data())
@settings(max_examples=60)
def test_random_access(ids, data):
    file = dac.DacFile(dac.encode_file(np.array([4, 9]), np.array([False, True]), np.array([0, len(ids) // 2, len(ids)]), np.array(ids, dtype=np.uint32)))
    assert [file.get(i) for i in range(len(ids))] == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert file.read(a, b).tolist() == ids[a:b]


def test_rank_directory_over_blocks():
    ids = np.random.default_rng(0).integers(0, 70_000, 5000).astype(np.uint32)
    file = dac.DacFile(dac.encode_file(np.array([1]), np.array([False]), np.array([0, 5000]), ids))
    assert [file.get(i) for i in range(0, 5000, 37)] == ids[::37].tolist() and file.read(513, 4096).tolist() == ids[513:4096].tolist()


# ---- 7 language model

def test_scores(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", *[f"s{i}ng" for i in range(60)]], k=rng.randint(0, 60))) for _ in range(400)] + [None]
    rows = mixlm.score_documents(documents(spark, texts), frequent=20).collect()
    count, ends = Counter(), 0
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(words_of(t))
            ends += 1
    total, kinds = sum(count.values()) + ends, len(count) + 1
    for r in rows:
        w = words_of(texts[r.doc_id])
        base = sum(np.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w) + np.log10((ends + 0.5) / (total + 0.5 * (kinds + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, 1 + sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    usual = next(r for r in rows if r.n_tokens > 20)
    odd_rows = mixlm.score_documents(documents(spark, [*texts, "qqxz vvkj zzpq"])).where("doc_id = 401").first()
    assert odd_rows.score / odd_rows.n_tokens < usual.score / usual.n_tokens


def small_model(spark, texts):
    """A model of some texts and the words it knows."""
    count = Counter(w for t in texts for w in words_of(t))
    known = sorted(w for w, n in count.items() if n > 1)
    raw = "".join(known).encode()
    ends = np.cumsum([len(w.encode()) for w in known])
    h = textkernel.span_hashes(np.frombuffer(raw, np.uint8), ends - [len(w.encode()) for w in known], ends)
    vocabulary = mixlm.Vocabulary(h, np.array([count[w] for w in known]), len(texts), sum(n for n in count.values() if n == 1))
    return mixlm.learn(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary, sum(count.values()) + len(texts)), known


def steps_of(model, texts):
    import pyarrow as pa

    return mixlm.Steps(*textkernel.texts_of(pa.array(texts)), model.vocabulary, model.vocabulary.table())


@given(st.lists(st.integers(1, 1000), min_size=2, max_size=40))
@settings(max_examples=60)
def test_prefix_codes(counts):
    """Codes decode without doubt, use all leaves, and no code is cheaper in all than Huffman's by another way."""
    import heapq

    counts = np.array(sorted(counts, reverse=True))
    code, length = mixlm.prefix_codes(counts)
    texts = [bin(c)[3:] for c in code.tolist()]
    assert [len(t) for t in texts] == length.tolist() and sum(2.0**-n for n in length) == 1
    assert not any(a != b and b.startswith(a) for a in texts for b in texts)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((counts * length).sum()) == cost


def test_steps_are_a_distribution(spark):
    """After any beginning the chances of all tokens sum to one, and those of all next bytes of a spelled word."""
    rng = random.Random(3)
    model, known = small_model(spark, [prose(rng, 30) + f" once{i}" for i in range(30)])
    for begin in ("", "w1 w2", "w7 zzz w9"):
        steps = steps_of(model, [*[f"{begin} {w}" for w in known], f"{begin} zz", begin])
        logp = model.along(steps, model.weights, False)[0]
        place = steps_of(model, [begin]).lane.size - 1  # the step after the beginning
        assert sum(10 ** logp[np.flatnonzero(steps.lane == k)[place]] for k in range(len(known) + 2)) == pytest.approx(1, abs=1e-4)
    words_ = [chr(c) for c in range(33, 127) if not 65 <= c < 91] + [chr(c) for c in (0xE9, 0x416, 0x4E00, 0x1F600)]
    steps = steps_of(model, [f"on{c}" for c in words_] + ["on"])
    logp = model.along(steps, model.weights, False)[0]
    assert sum(10 ** logp[np.flatnonzero(steps.lane == k)[3]] for k in range(len(words_) + 1)) <= 1 + 1e-4


def test_mixing_bit_by_bit(spark):
    """The same by plain loops: look up, mix, refine, and follow the errors after each block."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 60)) + f" new{i} w3 w4" for i in range(40)]
    model, _ = small_model(spark, texts)
    text = " ".join(prose(rng, 50).split() + ["strange", "word"] + texts[3].split())
    steps = steps_of(model, [text])
    got = model.along(steps, model.weights, False)[0]
    own = {g: model.weights[g].astype(float).copy() for g in range(mixlm._SETS)}
    energy = {g: np.full(mixlm.PREDICTORS, mixlm._CALM) for g in own}
    trust, trust_energy, at, cut, want = 0.5, mixlm._CALM, 0, 0, []
    while at < len(steps.lane):
        cut += min(max(mixlm.STEP, cut // 4), mixlm.MOST_STEP)
        grads, pull = defaultdict(lambda: np.zeros(mixlm.PREDICTORS)), 0.0
        for t in range(at, min(cut, len(steps.lane))):
            code, n, total, g = int(steps.code[t]), int(steps.length[t]), 0.0, None
            for d in range(n):
                node, bit = code >> (n - d), code >> (n - d - 1) & 1
                h = ((node + (int(steps.kind[t]) << 62)) * int(mixlm._GOLD) % 2**64) >> 32
                x = np.array([model.odds[k][model.tables[k][((int(steps.context[k, t]) + h) % 2**32) >> (32 - model.sizes[k])]] for k in range(mixlm.PREDICTORS)], dtype=float)
                g = int((x != 0).sum() + steps.kind[t] * (mixlm.PREDICTORS + 1)) if g is None else g
                z = min(max(float(own[g] @ x), -12), 12)
                p = 1 / (1 + np.exp(-z))
                r = model.refine[g * mixlm._CELLS + 24 + int(np.rint(z * 2))]
                chance = p + trust * (r - p)
                chance = chance if bit else 1 - chance
                total += np.log10(chance)
                grads[g] += (bit - p) * x
                pull += (1 if bit else -1) * (r - p) / chance
            want.append(total)
        for g, step in grads.items():
            energy[g] += step * step
            own[g] += mixlm._RATE * step / np.sqrt(energy[g])
        trust_energy += pull * pull
        trust, at = min(max(trust + mixlm._RATE * pull / np.sqrt(trust_energy), 0), 1), cut
    assert sum(want) == pytest.approx(got.sum(), rel=1e-3) and np.allclose(want, got, atol=0.05)


def test_mixer_decides_the_score(spark):
    """Held-out texts are likelier than under a fair unigram that spells new words, and a mixer that knows nothing says much else."""
    rng = random.Random(12)
    nouns = [f"noun{i}" for i in range(60)]
    texts = [" ".join(f"{rng.choice(['the', 'a'])} {w} of {w}s" for w in rng.choices(nouns, k=30)) for _ in range(200)]
    model, known = small_model(spark, texts[:150])
    steps = steps_of(model, texts[150:])
    score = model.along(steps, model.weights, False)[0].sum()
    count = Counter(w for t in texts[:150] for w in [*words_of(t), None])
    total = sum(count.values())
    unigram = sum(np.log10(count[w] / total) for t in texts[150:] for w in [*words_of(t), None])
    blank = mixlm.Model(model.vocabulary, model.sizes, [np.zeros_like(x) for x in model.tables], np.zeros((mixlm.PREDICTORS, 2, 4096)))
    nothing = blank.along(steps, blank.weights, False)[0].sum()
    assert score > 0.7 * unigram and score > 0.8 * nothing


def test_scores_see_the_order_of_words(spark):
    """Contexts cross word borders: a text in the order that training texts have is likelier than the same words in another."""
    line = "the grey cat sat on a warm stone near the old mill and slept"
    texts = [line + f" {i % 7}" for i in range(60)]
    held = [i for i in range(60, 400) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    other = " ".join(sorted(line.split(), key=lambda w: w[::-1]))
    rows = mixlm.score_documents(documents(spark, [*texts, (held[0], line), (held[1], other)])).where(F.col("doc_id").isin(held)).collect()
    usual, mixed = sorted(rows, key=lambda r: r.doc_id)
    assert usual.held_out and mixed.held_out and usual.base_score == pytest.approx(mixed.base_score)
    assert usual.score > mixed.score + 1 and usual.bits_per_byte < mixed.bits_per_byte


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """The same rows in 1, 3 and 7 partitions, and in another order, learn the same model from several buckets."""
    monkeypatch.setattr(mixlm, "BUCKET", 2000)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(80)], weights=range(1, 81), k=rng.randint(0, 40))) for _ in range(150)] + [None, "", "w1 " * 900]
    df = documents(spark, texts)
    runs = [
        {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in mixlm.score_documents(x).collect()}
        for x in (df.coalesce(1), df.repartition(3), df.orderBy(F.desc("doc_id")).repartition(7))
    ]
    for other in runs[1:]:
        assert other.keys() == runs[0].keys()
        assert all(other[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in runs[0].items())


@pytest.mark.parametrize("slots", [[0], [mixlm.CHUNK - 1], [0, 5, 6, mixlm.CHUNK - 1], list(range(mixlm.CHUNK))])
def test_packed_counts(slots):
    rng, at = np.random.default_rng(3), np.array(slots)
    counts = rng.integers(0, 2**31, (2, len(at)), dtype=np.int32)
    back = mixlm._unpack(mixlm._pack(at, *counts), len(at))
    assert back[0].tolist() == slots and back[1].tolist() == counts[0].tolist() and back[2].tolist() == counts[1].tolist()


def test_tables_grow():
    sizes = [mixlm.table_bits(n, n // 10) for n in (0, 1000, 10**5, 10**9)]
    assert all(a <= b for x, y in zip(sizes, sizes[1:]) for a, b in zip(x, y)) and sizes[1] != sizes[2]


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, 1 + i % 7) for i in range(70)] + [(100, 5000), (101, 900)], "k long, n long")
    assert {r.k for r in ranking.most_frequent(df, "n", 12).collect()} == {100, 101, *range(6, 70, 7)}
    assert ranking.most_frequent(df, "n", 11).count() == 2 and ranking.most_frequent(df, "n", 100).count() == 72 and ranking.most_frequent(df.limit(0), "n", 3).count() == 0


# ---- 8 exact dedup

@pytest.mark.parametrize("block, bits", [(16384, 64), (16, 64), (16, 3)])
def test_exact_duplicates(spark, block, bits):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)]
    texts += texts[:30] + [t + " " for t in texts[:5]] + ["", None, texts[0][:-1]]
    rows = naming.exact_duplicates(documents(spark, texts), block, bits).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(groups[t]), len(groups[t]), r.doc_id == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())


# ---- 9 token counts

@pytest.mark.parametrize("table", [1, 1 << 16])
def test_token_counts(spark, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = TRICKY + ["<s> </s> <unk>", "a▁ b ▁▁ c", "  two  spaces  ", prose(random.Random(1), 3000), "", None]
    for r in tokencount.token_counts(documents(spark, texts), PIECE, table=table).collect():
        t = texts[r.doc_id] or ""
        n = len(model.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096), t


# ---- 10 near-dedup

@pytest.mark.parametrize("width, threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates(spark, width, threshold):
    texts = near_corpus() + ["", None, "one", "one", "two words", "Two Words", " "]
    ids, sets = list(range(len(texts))), sets_of(texts, width)
    want = component_ids(ids, sets, threshold)
    for chunk in (1024, 4):
        neardup.CHUNK_SETS, kept = chunk, neardup.CHUNK_SETS
        rows = neardup.near_duplicates(documents(spark, texts), width, threshold).collect()
        neardup.CHUNK_SETS = kept
        assert {r.doc_id: r.component_id for r in rows} == want and all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id]) for r in rows)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert (neardup.sketches(a, np.array([0, len(a)]), 96) < np.iinfo(np.uint64).max).all()
    common, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    x, y = np.concatenate((common, own[0])), np.concatenate((common, own[1]))
    s = neardup.sketches(np.concatenate((x, y)), np.array([0, 900, 1800]), 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.03)


# ---- odd rows and empty tables

LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "shards": lambda d, s: hilbert.shard_documents(d),
    "mix": lambda d, s: mixing.mix(d),
    "toxicity": lambda d, s: toxicity.toxicity_scores(d, s.createDataFrame([(0, 1, 1), (2, None, 0), (None, 1, 1), (3, 1, None), (2, 1, 0)], LABELS)),
    "leaks": lambda d, s: decontam.contaminated(d, s.createDataFrame([(1, "a b"), (None, "other text of the same id"), (2, None)], "item_id long, text string")),
    "token files": lambda d, s: dac.token_ids(d, BPE),
    "scores": lambda d, s: mixlm.score_documents(d),
    "copies": lambda d, s: naming.exact_duplicates(d, 64),
    "counts": lambda d, s: tokencount.token_counts(d, PIECE),
    "near": lambda d, s: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    rows = OPERATORS[name](odd, spark).collect()
    if name == "leaks":
        assert {(r.doc_id, r.item_id) for r in rows} == {(3, 1)}
    else:
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    if name == "near":
        by = defaultdict(set)
        for r in rows:
            by[r.doc_id].add((r.component_id, r.kept))
        assert by[6] == {(5, False)} and by[None] == {(None, True)} and by[13] == {(12, False)}
    if name == "copies":
        assert {(r.keep_id, r.kept) for r in rows if r.doc_id is None} == {(None, True), (1, False)}


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "leaks"])
def test_texts_longer_than_a_slice(spark, name):
    """A text above the slice's size, and a word above it, beside short ones."""
    texts = ["short one", " ".join(f"w{i % 5000}" for i in range(200_000)), "y" * 1_100_000, "short two", " ".join(f"w{i % 5000}" for i in range(200_000))]
    assert len(texts[1]) > textkernel.SLICE < len(texts[2])
    rows = {r.doc_id: r for r in OPERATORS[name](documents(spark, texts), spark).collect()}
    assert sorted(rows) == list(range(5))
    if name == "near":
        assert (rows[4].component_id, rows[4].n_shingles, rows[2].n_shingles) == (1, 5000, 1)
    if name == "copies":
        assert (rows[1].keep_id, rows[1].group_size) == (4, 2)
    if name == "scores":
        assert rows[1].n_tokens == 200_001 and rows[1].score == rows[4].score < rows[0].score


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, empty, name):
    assert OPERATORS[name](empty, spark).count() == 0
