"""Local homology search: protein chains against nucleotide subjects read in six frames.

1. Subjects are cut into overlapping pieces and translated in all frames, by columns.
2. Chains and frames meet by words of ``WORD`` letters.  Words that come more than
   ``FREQUENT`` times in the subjects meet by twice as many letters instead, so no word
   multiplies without bound; ``frequent_words`` tells which.
3. Two different words on one diagonal within ``REACH`` letters make a candidate: a band of
   diagonals of a chain and a frame.
4. Tasks align candidates in batches, each within its band, with affine gaps, and keep
   the best local alignment.
5. Alignments that share an end are one; each has an expectation value.

Words are joined by equal keys that Spark can split when skewed, and sequences travel
once for each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions import sequence as S

WORD, FREQUENT, REACH, BAND, PIECE = 4, 10_000, 40, 32, 10_000
# Six classes of residues that replace each other easily.
CLASSES = ("AGPST", "C", "DENQ", "FWY", "HKR", "ILMV")
_NEVER = -(1 << 20)
HITS = "chain_id {id}, acc {acc}, frame int, score int, q_start int, q_end int, s_from int, s_to int, align_len int, identities int, query string, subject string, match string"


@dataclass(frozen=True)
class Scoring:
    """Scores of residue pairs by identity and class, and of gaps; ``k`` scales expectation values."""

    same: int = 6
    alike: int = 1
    other: int = -3
    unknown: int = -4
    opening: int = 11
    extending: int = 1
    k: float = 0.041

    @cached_property
    def table(self) -> np.ndarray:
        out = np.full((256, 256), self.unknown, dtype=np.int32)
        letters = [ord(c) for group in CLASSES for c in group]
        out[np.ix_(letters, letters)] = self.other
        for group in CLASSES:
            out[np.ix_([ord(c) for c in group], [ord(c) for c in group])] = self.alike
        out[letters, letters] = self.same
        return out

    @cached_property
    def rate(self) -> float:
        """The positive root of sum p_i p_j exp(rate * s_ij) = 1 for letters that are equally frequent (Karlin, Altschul 1990)."""
        letters = [ord(c) for group in CLASSES for c in group]
        s = self.table[np.ix_(letters, letters)]
        low, high = 1e-6, 5.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if np.exp(mid * s).mean() < 1 else (low, mid)
        return low

    def expect(self, score: Column, query: Column, letters: Column) -> Column:
        """How many alignments of that score chance would give."""
        return F.lit(self.k) * query * letters * F.exp(-self.rate * score)


def frames(subjects: DataFrame, overlap: int, piece: int = PIECE) -> DataFrame:
    """acc, piece_start, piece_len, frame (1 to 3, -1 to -3) and ``letters`` of pieces of subjects (acc, nt).

    A piece has ``piece`` letters of its own and ``overlap`` of the next.
    """
    step, size = 3 * piece, F.length("nt")
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step))
    cut = subjects.where(size >= 3).select("acc", F.explode(starts).alias("piece_start"), "nt")
    cut = cut.select("acc", "piece_start", F.substr("nt", F.col("piece_start") + 1, F.lit(step + 3 * overlap)).alias("nt"))
    turned = S.reverse_complement(F.col("nt"))
    every = F.array(*[F.struct(F.lit(sign * (k + 1)).alias("frame"), F.substr(nt, F.lit(k + 1)).alias("read")) for sign, nt in ((1, F.col("nt")), (-1, turned)) for k in range(3)])
    out = cut.select("acc", "piece_start", F.length("nt").alias("piece_len"), F.explode(every).alias("f"))
    return out.select("acc", "piece_start", "piece_len", "f.frame", S.translate(F.col("f.read")).alias("letters"))


def _words(rows: DataFrame, text: str, keys: list[str], size: int) -> DataFrame:
    """Keys, ``at`` (from 0), ``word`` and ``long`` (null near the end) for all words without unknown letters or stops."""
    n = F.length(text)
    places = F.explode(F.sequence(F.lit(0), n - size)).alias("at")
    out = rows.where(n >= size).select(*keys, text, places)
    out = out.select(*keys, "at", F.substr(text, F.col("at") + 1, F.lit(size)).alias("word"), F.when(n - F.col("at") >= 2 * size, F.substr(text, F.col("at") + 1, F.lit(2 * size))).alias("long"))
    return out.where(~F.col("word").rlike("[X*]"))


def frequent_words(subjects_words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Words that come more than ``frequent`` times: they seed by twice their letters."""
    return subjects_words.groupBy("word").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > frequent)


def candidates(chains: DataFrame, pieces: DataFrame, word: int = WORD, frequent: int = FREQUENT, reach: int = REACH, band: int = BAND) -> DataFrame:
    """chain_id, acc, piece_start, frame and ``diagonals`` (the number of a band of ``band`` diagonals) to align.

    ``chains``: chain_id, seq; ``pieces``: see ``frames``.
    """
    of = ["acc", "piece_start", "frame"]
    ours, theirs = _words(chains, "seq", ["chain_id"], word), _words(pieces, "letters", of, word)
    often = F.broadcast(frequent_words(theirs, frequent).select("word", F.lit(True).alias("often")))  # there are 20 ** word words
    key = F.when(F.col("often").isNull(), F.col("word")).otherwise(F.col("long")).alias("key")
    left = ours.join(often, "word", "left").select("chain_id", F.col("at").alias("q"), key).where("key IS NOT NULL")
    right = theirs.join(often, "word", "left").select(*of, F.col("at").alias("s"), key).where("key IS NOT NULL")
    met = left.join(right, "key").select("chain_id", *of, "q", (F.col("s") - F.col("q")).alias("d")).distinct()
    before = F.lag("q").over(Window.partitionBy("chain_id", *of, "d").orderBy("q"))
    near = met.withColumn("gap", F.col("q") - before).where(F.col("gap") <= reach)
    return near.select("chain_id", *of, F.floor(F.col("d") / band).cast("int").alias("diagonals")).distinct()


def align_bands(queries: list[bytes], subjects: list[bytes], first: np.ndarray, width: int, scoring: Scoring) -> list[tuple[int, int, int, int, int, str]]:
    """The best local alignment of each pair within ``width`` diagonals from ``first`` on.

    Returns score, q_start, q_end, s_start, s_end (from 0, ends excluded) and the path,
    a letter a column: M both, D a gap in the subject, I a gap in the query.  Of equal
    scores the earliest end in the query, then in the subject, counts; a path prefers
    pairs, then gaps in the subject, and short gaps.
    """
    n, rows = len(queries), max(map(len, queries))
    q, s = np.zeros((n, rows), dtype=np.uint8), np.zeros((n, max(map(len, subjects))), dtype=np.uint8)
    for k, (a, b) in enumerate(zip(queries, subjects)):
        q[k, : len(a)], s[k, : len(b)] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    q_len, s_len = np.array([*map(len, queries)])[:, None], np.array([*map(len, subjects)])[:, None]
    offsets = np.arange(width)
    ahead = scoring.extending * offsets
    start_gap = scoring.opening + scoring.extending
    h, e = np.zeros((n, width + 1), dtype=np.int32), np.full((n, width + 1), _NEVER, dtype=np.int32)
    trail = np.zeros((rows, n, width), dtype=np.uint8)
    best, at_i, at_o = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    each = np.arange(n)
    for i in range(rows):
        j = first[:, None] + i + offsets
        inside = (j >= 0) & (j < s_len) & (i < q_len)
        pair = h[:, :-1] + scoring.table[q[:, i][:, None], np.take_along_axis(s, np.clip(j, 0, s.shape[1] - 1), axis=1)]
        longer = e[:, 1:] - scoring.extending
        fresh = h[:, 1:] - start_gap
        up = np.maximum(longer, fresh)
        m = np.where(inside, np.maximum(np.maximum(pair, up), 0), _NEVER)
        reach = np.maximum.accumulate(m + ahead, axis=1)
        left = np.full((n, width), _NEVER, dtype=np.int32)
        left[:, 1:] = reach[:, :-1] - scoring.opening - ahead[1:]
        now = np.where(inside, np.maximum(m, left), 0)
        opened = np.zeros((n, width), dtype=bool)
        opened[:, 1:] = left[:, 1:] == m[:, :-1] - start_gap
        trail[i] = np.where(now <= 0, 0, np.where(now == pair, 1, np.where(now == up, 2, 3))) | (longer > fresh) * np.uint8(4) | ~opened * np.uint8(8)
        h[:, :-1], e[:, :-1] = now, np.where(inside, up, _NEVER)
        top = now.argmax(axis=1)
        better = now[each, top] > best
        best[better], at_i[better], at_o[better] = now[each, top][better], i, top[better]
    out = []
    for k in range(n):
        i, o, path = int(at_i[k]), int(at_o[k]), []
        end_i, end_j = i + 1, i + o + int(first[k]) + 1
        score, state = int(best[k]), 1
        while score and i >= 0:
            code = int(trail[i, k, o])
            if state == 1:
                kind = code & 3
                if kind == 0:
                    break
                if kind == 1:
                    path.append("M")
                    i -= 1
                    if i < 0 or not trail[i, k, o] & 3:
                        break
                    continue
                state = kind
            if state == 2:
                path.append("D")
                state = 2 if code & 4 else 1
                i, o = i - 1, o + 1
            elif state == 3:
                path.append("I")
                state = 3 if code & 8 else 1
                o -= 1
        path.reverse()
        text = "".join(path)
        out.append((score, end_i - text.count("M") - text.count("D"), end_i, end_j - text.count("M") - text.count("I"), end_j, text))
    return out


def _written(query: str, subject: str, path: str, table: np.ndarray) -> tuple[str, str, str]:
    """Both sequences with gaps, and a line with a letter where they agree and + where they are alike."""
    a, b, line = [], [], []
    x, y = iter(query), iter(subject)
    for step in path:
        p, r = next(x) if step != "I" else "-", next(y) if step != "D" else "-"
        a.append(p)
        b.append(r)
        line.append(" " if "-" in (p, r) else p if p == r else "+" if table[ord(p), ord(r)] > 0 else " ")
    return "".join(a), "".join(b), "".join(line)


def _align(band: int, scoring: Scoring, kinds: list[pa.DataType], cells: int = 32 << 20):
    width = 3 * band  # the candidate's own diagonals and as many on either side
    names = [x.split()[0] for x in HITS.split(", ")]
    types = [*kinds, *[pa.int32()] * 8, *[pa.string()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            rows.sort(key=lambda r: len(r["seq"]))
            at = 0
            while at < len(rows):
                n = 1
                while at + n < len(rows) and (n + 1) * len(rows[at + n]["seq"]) * width <= cells and n < 512:
                    n += 1
                part = rows[at : at + n]
                at += n
                queries, letters = [r["seq"].encode() for r in part], [r["letters"].encode() for r in part]
                low = np.array([(r["diagonals"] - 1) * band for r in part])
                begin = np.clip(low, 0, None)  # only what the band touches of the subject
                cut = [s[max(b, 0) : max(b + len(q) + width, 0)] or b"*" for s, q, b in zip(letters, queries, begin)]
                out = []
                for r, b, (score, qa, qe, sa, se, path) in zip(part, begin.tolist(), align_bands(queries, cut, low - begin, width, scoring)):
                    if score:
                        sa, se = sa + b, se + b
                        a, s, line = _written(r["seq"][qa:qe], r["letters"][sa:se], path, scoring.table)
                        same = sum(x == y for x, y in zip(a, s))
                        head = (r["chain_id"], r["acc"], r["frame"], score, qa + 1, qe)
                        f, start, size = abs(r["frame"]) - 1, r["piece_start"], r["piece_len"]
                        ends = (start + f + 3 * sa + 1, start + f + 3 * se) if r["frame"] > 0 else (start + size - f - 3 * se + 1, start + size - f - 3 * sa)
                        out.append((*head, *ends, len(path), same, a, s, line))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return run


def search(chains: DataFrame, subjects: DataFrame, limit: float = 0.1, scoring: Scoring = Scoring(), word: int = WORD, frequent: int = FREQUENT, reach: int = REACH, band: int = BAND, piece: int = PIECE) -> DataFrame:
    """Hits of chains (chain_id, seq) in subjects (acc, title, nt) with an expectation value below ``limit``.

    chain_id, hit (from 0, best first), title, acc, frame, score, expect, align_len,
    identities, q_start, q_end, query, s_start, s_end, subject and match.  Positions count
    from 1, those of the subject are nucleotides of the given strand, ends included.
    ``acc`` must tell subjects apart and chain_id chains; null sequences have no hits.
    An alignment that drifts more than ``band`` diagonals beyond its candidate's is found
    in parts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    chains = chains.select("chain_id", F.upper("seq").alias("seq")).where("length(seq) > 0")
    plain = subjects.select("acc", F.upper("nt").alias("nt")).where("nt IS NOT NULL")
    longest = chains.agg(F.coalesce(F.max(F.length("seq")), F.lit(0))).first()[0]
    total = plain.agg(F.coalesce(F.sum(F.length("nt") / 3), F.lit(0.0))).first()[0]
    pieces = frames(plain, longest + 2 * band, piece)
    pairs = candidates(chains, pieces, word, frequent, reach, band)
    full = pairs.join(chains, "chain_id").join(pieces, ["acc", "piece_start", "frame"])
    kinds = [chains.schema["chain_id"].dataType, plain.schema["acc"].dataType]
    found = full.mapInArrow(_align(band, scoring, [to_arrow_type(k) for k in kinds]), HITS.format(id=kinds[0].simpleString(), acc=kinds[1].simpleString()))
    strand = F.signum(F.col("frame").cast("double"))
    rest = [c for c in found.columns if c not in ("chain_id", "acc")]
    for ends in (["q_start", "s_from", "s_to"], ["q_start", F.when(strand > 0, F.col("s_from")).otherwise(F.col("s_to"))], ["q_end", F.when(strand > 0, F.col("s_to")).otherwise(F.col("s_from"))]):
        keys = [F.col(e).alias(f"k{k}") if isinstance(e, str) else e.alias(f"k{k}") for k, e in enumerate(ends)]
        best = found.groupBy("chain_id", "acc", strand.alias("strand"), *keys).agg(F.max(F.struct("score", *[c for c in rest if c != "score"])).alias("b"))
        found = best.select("chain_id", "acc", *[F.col(f"b.{c}").alias(c) for c in rest])
    scored = found.join(chains.select("chain_id", F.length("seq").alias("n")), "chain_id").withColumn("expect", scoring.expect(F.col("score"), F.col("n"), F.lit(float(total)))).where(F.col("expect") < limit)
    named = scored.join(subjects.select("acc", "title", F.length("nt").alias("size")), "acc")
    named = named.withColumn("frame", F.when(F.col("frame") > 0, F.col("frame")).otherwise(-((F.col("size") - F.col("s_to")) % 3 + 1)).cast("int"))  # a piece's own end is no frame
    order = Window.partitionBy("chain_id").orderBy("expect", "acc", "s_from", "q_start", "frame")
    return named.select(
        "chain_id", (F.row_number().over(order) - 1).alias("hit"), "title", "acc", "frame", "score", "expect", "align_len", "identities", "q_start", "q_end", "query",
        F.col("s_from").alias("s_start"), F.col("s_to").alias("s_end"), "subject", "match",
    )
