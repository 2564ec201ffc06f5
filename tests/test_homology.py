"""Local homology search against plain alignment of whole sequences."""

import random

import numpy as np
import pytest

from chainloom.functions.lookup import CODON_FAMILY, CODONS
from chainloom.operators import homology
from chainloom.plans import etl

AA = "ACDEFGHIKLMNPQRSTVWY"
SCORING = homology.Scoring()


def plain_best(q, s):
    """Best local alignment score, and its end, of two whole sequences (Gotoh 1982)."""
    rows, cols = len(q) + 1, len(s) + 1
    h = [[0] * cols for _ in range(rows)]
    e, f = ([[-(10**6)] * cols for _ in range(rows)] for _ in range(2))
    best = (0, 0, 0)
    for i in range(1, rows):
        for j in range(1, cols):
            e[i][j] = max(e[i - 1][j] - 1, h[i - 1][j] - 12)
            f[i][j] = max(f[i][j - 1] - 1, h[i][j - 1] - 12)
            h[i][j] = max(0, h[i - 1][j - 1] + int(SCORING.table[ord(q[i - 1]), ord(s[j - 1])]), e[i][j], f[i][j])
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    return best


def score_of(a, b):
    """The score that a written alignment has."""
    out, gap = 0, ""
    for x, y in zip(a, b):
        now = "q" if x == "-" else "s" if y == "-" else ""
        out += int(SCORING.table[ord(x), ord(y)]) if not now else -1 if now == gap else -12
        gap = now
    return out


def mutated(rng, seq, share=0.1, gaps=2):
    out = [rng.choice(AA) if rng.random() < share else c for c in seq]
    for _ in range(gaps):
        at = rng.randrange(5, len(out) - 5)
        out[at:at] = rng.choices(AA, k=rng.randint(1, 3))
    return "".join(out)


def nt_of(rng, protein):
    return "".join(rng.choice(CODONS[c]) for c in protein)


def turned(nt):
    return nt[::-1].translate(str.maketrans("ACGT", "TGCA"))


def read(nt, frame):
    nt = (nt if frame > 0 else turned(nt))[abs(frame) - 1 :]
    return "".join(CODON_FAMILY.get(nt[k : k + 3], "X") for k in range(0, len(nt) - 2, 3))


def test_bands_equal_whole_tables():
    rng = random.Random(2)
    qs = ["".join(rng.choices(AA, k=rng.randint(1, 60))) for _ in range(60)]
    ss = [mutated(rng, q * 2) if len(q) > 10 else "".join(rng.choices(AA, k=rng.randint(1, 60))) for q in qs]
    got = homology.align_bands([q.encode() for q in qs], [s.encode() for s in ss], np.full(60, -70), 300, SCORING)
    for q, s, (score, qa, qe, sa, se, path) in zip(qs, ss, got):
        want = plain_best(q, s)
        assert score == want[0] and (not score or (qe, se) == want[1:])
        if score:
            a, b, _ = homology._written(q[qa:qe], s[sa:se], path, SCORING.table)
            assert score_of(a, b) == score and a.replace("-", "") == q[qa:qe] and b.replace("-", "") == s[sa:se]


def test_rate():
    letters = [ord(c) for c in AA]
    assert np.exp(SCORING.rate * SCORING.table[np.ix_(letters, letters)]).mean() == pytest.approx(1)


@pytest.fixture(scope="module")
def planted():
    """Chains, subjects with mutated copies of some in all frames, and one pair of long subjects."""
    rng = random.Random(5)
    chains = [(f"c{k}", "".join(rng.choices(AA, k=rng.randint(60, 140)))) for k in range(12)]
    subjects = []
    for k in range(18):
        coded = nt_of(rng, mutated(rng, chains[k % 9][1]))
        nt = "".join(rng.choices("ACGT", k=rng.randint(20, 200))) + coded + "".join(rng.choices("ACGT", k=rng.randint(20, 200)))
        subjects.append((f"a{k}", f"gi|1|ref|a{k}| organism{k % 3}, title {k}", turned(nt) if k % 2 else nt))
    return chains, subjects


def found(spark, chains, subjects, **more):
    return homology.search(spark.createDataFrame(chains, "chain_id string, seq string"), spark.createDataFrame(subjects, "acc string, title string, nt string"), **more).collect()


def test_search_equals_plain_alignment(spark, planted):
    chains, subjects = planted
    rows = found(spark, chains + [(None, None), ("c99", "")], subjects + [("none", "t", None), ("short", "t", "AC")])
    seq, nts = dict(chains), {a: nt for a, _, nt in subjects}
    best = {}
    for r in rows:
        part = nts[r.acc][r.s_start - 1 : r.s_end]
        assert read(part, 1 if r.frame > 0 else -1) == r.subject.replace("-", "") and seq[r.chain_id][r.q_start - 1 : r.q_end] == r.query.replace("-", "")
        assert score_of(r.query, r.subject) == r.score and r.identities == sum(x == y for x, y in zip(r.query, r.subject)) and r.align_len == len(r.query) == len(r.match)
        assert r.expect < 0.1
        best[r.chain_id, r.acc] = max(best.get((r.chain_id, r.acc), 0), r.score)
    total = sum(len(nt) for _, _, nt in subjects) / 3 + 2 / 3
    for c, q in chains:
        for a, _, nt in subjects:
            want = max(plain_best(q, read(nt, f))[0] for f in (1, 2, 3, -1, -2, -3))
            expect = 0.041 * len(q) * total * np.exp(-SCORING.rate * want)
            if expect < 1e-8:  # weaker ones may share no two words
                assert best.get((c, a)) == want, (c, a)
            elif (c, a) in best:
                assert best[c, a] <= want and expect < 0.1
    assert len({(c, a) for c, a in best}) >= 18
    for c in {r.chain_id for r in rows}:
        mine = sorted((r for r in rows if r.chain_id == c), key=lambda r: r.hit)
        assert [r.hit for r in mine] == list(range(len(mine))) and [r.expect for r in mine] == sorted(r.expect for r in mine)


def key(rows):
    return sorted((r.chain_id, r.acc, r.frame, r.score, r.q_start, r.q_end, r.s_start, r.s_end, r.query, r.subject) for r in rows)


def test_pieces_do_not_matter(spark, planted):
    chains, subjects = planted
    long = [("x", "t", "".join(nt for _, _, nt in subjects[:12])), *subjects[12:]]
    assert key(found(spark, chains, long)) == key(found(spark, chains, long, piece=37))


def test_frequent_words_seed_by_longer_ones(spark, planted):
    """With every word frequent, the same alignments come from words of eight letters."""
    chains, subjects = planted
    some = {(r.chain_id, r.acc): r.score for r in found(spark, chains, subjects, frequent=0)}
    every = {(r.chain_id, r.acc): r.score for r in reversed(found(spark, chains, subjects))}
    assert some.items() <= every.items() and len(some) > 0.7 * len(every)


def test_hits_feed_the_pipeline(spark, planted):
    chains, subjects = planted
    hits = homology.search(spark.createDataFrame(chains, "chain_id string, seq string"), spark.createDataFrame(subjects, "acc string, title string, nt string"))
    best = etl.best_hits(hits.drop("acc").selectExpr("*", "'organism1' AS organism")).collect()
    assert len({r.chain_id for r in best}) == len(best) > 0 and all(r.acc.startswith("a") for r in best)


def test_nothing_to_search(spark):
    assert found(spark, [], [("a", "t", "ACGT")]) == found(spark, [("c", "ACDEF")], []) == []
