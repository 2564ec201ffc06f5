"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``MAX_LABELLED``) gives the lexicons: words
   and patterns (beginnings of 4, 5 and 6 bytes, in one, two or three words) that stand for "toxic" in at
   least three quarters of their rows, as many as keep the share of chance finds below
   ``FALSE_SHARE`` (Benjamini, Hochberg 1995), so terms of a language with few rows
   pass as well.  The strongest become voters: they fire or stay silent, and both tells
   of the class.
2. A generative label model over all documents says how the voters fire in either
   class: each voter's firing depends on the class and on one other voter, its parent
   in a tree, so a word and its beginning do not count twice.  Expectation
   maximisation estimates how often voters fire (their accuracies) and how they fire
   together with their parents (their correlations) in each class; the tree joins the
   voters that tell most of each other once the class is known.
   The sample's rows are of known class in every round; without them the few voters of a
   rare language drift to the class that the silence of all others speaks for.
3. A logistic regression over the lexicon features is fitted to the posterior labels
   of all documents, labelled or not, and gives the scores.  Its features are terms of
   toxic texts, so no weight may be negative.

Scale: two scans of the texts; the second leaves a few feature numbers for each
document.  Documents with the same features are counted together before anything is
estimated, so the rounds run over the distinct combinations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import HashTable, grouped, list_array, lower_ascii, mix, slices, span_hashes, texts_of
from .workspace import map_texts, materialise

MAX_LABELLED, FEATURES, VOTERS, BEGINNINGS, SEVERAL = 20_000, 2048, 128, (4, 5, 6), (2, 3)
EM_ROUNDS, FIT_ROUNDS, THRESHOLD, LEAST_PRECISION, FALSE_SHARE, STILL = 40, 20, 0.3, 0.75, 0.02, 0.05
_TASKS, _PRIOR = 32, 5.0
_SOLID = np.array([c > 127 or chr(c).isalnum() for c in range(256)])


def _terms(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row, as (hash, row).

    They are its words, between white space and ASCII marks, their beginnings, and
    beginnings that two or three different words share.
    """
    low = lower_ascii(part)
    solid = _SOLID[low]
    edges = at[(at > 0) & (at < len(low))]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[edges], last[edges - 1] = solid[edges], solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(at, starts, side="right") - 1
    h, r, _, pick = _distinct(span_hashes(low, starts, ends, salt=1), row)
    starts, ends = starts[pick], ends[pick]
    hashes, rows = [h], [r]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        begin, of, words, _ = _distinct(span_hashes(low, starts[long], starts[long] + n, salt=n), r[long])
        hashes.append(begin)
        rows.append(of)
        for least in SEVERAL:
            many = words >= least
            hashes.append(mix(begin[many], 100 + least))
            rows.append(of[many])
    return np.concatenate(hashes), np.concatenate(rows)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) pairs by row, how often each comes, and where it comes first."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(keep)
    return h[at], row[at], np.diff(at, append=len(h)), order[at]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, toxic, clean): documents of either label that have a feature."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        label = batch.column("toxic").to_numpy()
        for a, b in slices(offsets):
            h, r = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            unique, inverse = np.unique(h, return_inverse=True)
            bad = np.bincount(inverse, weights=label[a:b][r] == 1, minlength=len(unique)).astype(np.int64)
            all_ = np.bincount(inverse, minlength=len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], ["h", "bad", "good"])


def _present(shared, carried: list[str]):
    """The table's features that each document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(shared.value)
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for a, b in slices(offsets):
                h, r = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                where = table.find(h)
                hit = np.flatnonzero(where >= 0)
                hit = hit[np.lexsort((where[hit], r[hit]))]
                lists = list_array(where[hit], grouped(r[hit], b - a), pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in carried], lists], [*carried, "features"])

    return run


def _lexicon(sample: DataFrame, documents: DataFrame, features: int, voters: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Feature hashes, the voters' toxic and clean rows in the sample (a column each), and all such rows."""
    rows = documents.join(F.broadcast(sample), "doc_id").select("text", "toxic")  # at most MAX_LABELLED ids
    bad, all_ = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    share = (bad + 1) / (all_ + 20)
    rows_of = (bad, all_ - bad)
    tally = map_texts(rows, _tally, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tally = materialise(tally.where("bad + good >= 2"), "tally")
    b, g = F.col("bad"), F.col("good")
    part = lambda n, of, row: n / all_ * F.log((n * all_ + 1e-9) / (of * row + 1e-9))
    row = b + g
    gain = part(b, bad, row) + part(g, all_ - bad, row) + part(bad - b, bad, all_ - row) + part(all_ - bad - g, all_ - bad, all_ - row)
    if not bad or bad == all_:
        return np.zeros(0, dtype=np.uint64), np.zeros((2, 0)), rows_of
    terms = max(tally.count(), 1)
    best = tally.withColumn("gain", gain * all_).where((F.col("gain") > 0) & ((b + share) / (row + 1) >= LEAST_PRECISION)).orderBy(F.desc("gain"), "h").limit(features).toArrow()
    chance = np.array([math.erfc(math.sqrt(x)) for x in best.column("gain").to_pylist()])  # of so much gain for a term without meaning
    passing = np.flatnonzero(chance <= FALSE_SHARE * np.arange(1, len(chance) + 1) / terms)
    best = best.slice(0, int(passing[-1]) + 1 if len(passing) else 0)
    h, bad_n, good_n = best.column("h").to_numpy().view(np.uint64), best.column("bad").to_numpy(), best.column("good").to_numpy()
    return h, np.stack((bad_n, good_n))[:, :voters].astype(float), rows_of


def _sums(patterns: DataFrame, size: int, work: Callable[..., np.ndarray], columns: tuple[str, ...]) -> np.ndarray:
    """Sum ``work(features, row of each, patterns, columns...)``, an array of ``size`` numbers, over all patterns.

    ``_TASKS`` tasks at most each send one array, without a shuffle, and the driver adds those up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            lists = batch.column("features")
            off = lists.offsets.to_numpy()
            total += work(lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(off)), batch.num_rows, *[batch.column(c).to_numpy() for c in columns])
        yield pa.RecordBatch.from_arrays([list_array(total, np.array([0, size]), pa.float64())], ["v"])

    out = patterns.select("features", *columns).coalesce(_TASKS).mapInArrow(run, "v array<double>").toArrow()
    return out.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class LabelModel:
    """How voters fire in the clean (0) and the toxic (1) class, each given its parent; and the share of either class."""

    def __init__(self, features: int, counts: np.ndarray, rows: tuple[int, int]):
        v = counts.shape[1]
        self.features, self.voters = features, v
        self.fires = np.stack([(counts[1 - y] + 0.1) / (rows[1 - y] + 1) for y in (0, 1)])  # where the sample begins
        self.fires = np.clip(self.fires, 1e-5, 1 - 1e-5)
        self.prior = (rows[0] + 1) / (sum(rows) + 20)
        self.start, self.weight = self.fires.copy(), np.array([rows[1] + 1.0, rows[0] + 1.0])
        self.parent = np.full(v, -1)
        self.given = np.stack([self.fires] * 2, axis=1)  # class, whether the parent fires, voter

    def firings(self, f: np.ndarray, row: np.ndarray, docs: int) -> Iterator[tuple[int, np.ndarray]]:
        """The voters that fire, as a 0/1 matrix for some thousand documents at a time; voters are the first features."""
        on = f < self.voters
        at, k = row[on], f[on]
        for a in range(0, docs, 4096):
            lo, hi = np.searchsorted(at, [a, a + 4096])
            x = np.zeros((min(4096, docs - a), self.voters))
            x[at[lo:hi] - a, k[lo:hi]] = 1
            yield a, x

    def says(self) -> tuple[float, np.ndarray, np.ndarray]:
        """The log odds of "toxic" as a constant, what each voter adds, and what it adds together with its parent."""
        log = np.log(self.given)
        no = np.log1p(-self.given)
        fire, quiet = log[1] - log[0], no[1] - no[0]  # by parent, voter
        has = self.parent >= 0
        single = fire[0] - quiet[0]
        pair = np.where(has, fire[1] - quiet[1] - single, 0)
        np.add.at(single, self.parent[has], (quiet[1] - quiet[0])[has])
        return float(_logit(self.prior) + quiet[0].sum()), single, pair

    def posterior(self, f: np.ndarray, row: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Chance of "toxic" for each document; ``known`` is 1 or 0 where the class is known, else -1."""
        q = np.zeros(len(known))
        base, single, pair = self.says()
        for a, x in self.firings(f, row, len(known)):
            logit = base + x @ single + (x * x[:, np.maximum(self.parent, 0)]) @ pair
            q[a : a + len(x)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return np.where(known < 0, q, known)

    def update(self, docs: np.ndarray, joint: np.ndarray) -> None:
        """From the documents of each class, and how often pairs of voters fire together in each (the diagonal: alone or not)."""
        v = self.voters
        single = np.einsum("yii->yi", joint)
        self.prior = float(np.clip(docs[1] / max(docs.sum(), 1), 1e-4, 0.9))
        self.fires = np.clip((single + self.weight[:, None] * self.start) / (docs + self.weight)[:, None], 1e-6, 1 - 1e-6)
        told = np.zeros((v, v))  # what two voters tell of each other within a class
        for y in (0, 1):
            n, p = max(docs[y], 1e-9), self.fires[y]
            both = np.clip(joint[y] / n, 1e-12, 1)
            cells = [(both, np.outer(p, p)), (p[:, None] - both, np.outer(p, 1 - p)), (p[None] - both, np.outer(1 - p, p)), (1 - p[:, None] - p[None] + both, np.outer(1 - p, 1 - p))]
            told += n / max(docs.sum(), 1) * sum(np.where(c > 1e-12, c * np.log(np.maximum(c, 1e-12) / np.maximum(e, 1e-12)), 0) for c, e in cells)
        self.parent = spanning_tree(told)
        at = np.maximum(self.parent, 0)
        for y in (0, 1):
            with_parent = joint[y][at, np.arange(v)]
            for on, hits, rows in ((1, with_parent, single[y][at]), (0, single[y] - with_parent, docs[y] - single[y][at])):
                self.given[y, on] = np.clip((hits + _PRIOR * self.fires[y]) / (rows + _PRIOR), 1e-6, 1 - 1e-6)
        root = self.parent < 0
        self.given[:, :, root] = self.fires[:, None, root]


def spanning_tree(gain: np.ndarray) -> np.ndarray:
    """Each node's parent in the tree of largest gain (Chow, Liu 1968); the first node, and those that gain nothing, have none."""
    v = len(gain)
    parent, best, of = np.full(v, -1), np.full(v, -np.inf), np.zeros(v, dtype=int)
    left = np.ones(v, dtype=bool)
    here = 0
    for _ in range(v - 1):
        left[here] = False
        closer = left & (gain[here] > best)
        best[closer], of[closer] = gain[here][closer], here
        here = int(np.argmax(np.where(left, best, -np.inf)))
        parent[here] = of[here] if best[here] > 1e-9 else -1
    return parent


def _label_model(patterns: DataFrame, counts: np.ndarray, rows: tuple[int, int], features: int, rounds: int = EM_ROUNDS) -> LabelModel:
    """Rounds until no log odds of a voter moves by more than ``STILL``."""
    model = LabelModel(features, counts, rows)
    v = model.voters
    for _ in range(rounds):
        before = np.concatenate([np.log(model.given).reshape(-1), [_logit(model.prior)]])

        def work(f, row, docs, known, n):
            q = model.posterior(f, row, known)
            joint = np.zeros((2, v, v))
            for a, x in model.firings(f, row, docs):
                some = x.any(axis=1)
                x, part, of = x[some], q[a : a + len(x)][some], n[a : a + len(x)][some]
                toxic = (x * (part * of)[:, None]).T @ x
                joint[1] += toxic
                joint[0] += (x * of[:, None]).T @ x - toxic
            return np.concatenate((joint.reshape(-1), [n @ (1 - q), n @ q]))

        total = _sums(patterns, 2 * v * v + 2, work, ("known", "n"))
        model.update(total[-2:], total[:-2].reshape(2, v, v))
        if np.abs(np.concatenate([np.log(model.given).reshape(-1), [_logit(model.prior)]]) - before).max() < STILL:
            break
    return model


def _fit(patterns: DataFrame, model: LabelModel, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression on the posterior labels, from the label model's weights.

    Each round minimises a separable bound of the loss: the curvature is at most a
    quarter, and a document's features share it, so no round overshoots.
    """
    n = model.features
    base, single, _ = model.says()
    w, b = np.zeros(n), float(np.clip(base, -8, 0))
    w[: model.voters] = np.clip(single, 0, 8)
    here, before, pace = np.append(w, b), np.append(w, b), 1.0
    for _ in range(rounds):
        w0, b0 = here[:n], float(here[n])

        def work(f, row, docs, q, m):
            p = 1 / (1 + np.exp(-np.clip(b0 + np.bincount(row, weights=w0[f], minlength=docs), -30, 30)))
            size = np.bincount(row, minlength=docs) + 1  # bounds how far the features of a document can move together
            g, h = m * (p - q), 0.25 * m * size
            return np.concatenate((np.bincount(f, weights=g[row], minlength=n), [g.sum()], np.bincount(f, weights=h[row], minlength=n), [h.sum()]))

        total = _sums(patterns, 2 * n + 2, work, ("posterior", "n"))
        after = here - (total[: n + 1] + 0.01 * np.append(w0, 0)) / (total[n + 1 :] + 0.01)
        after[:n] = np.maximum(after[:n], 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2  # Nesterov's momentum
        here, before, pace = after + (pace - 1) / faster * (after - before), after, faster
        here[:n] = np.maximum(here[:n], 0)
    return before[:n], float(before[n])


def toxicity_scores(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, features: int = FEATURES, voters: int = VOTERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``, and its columns named in ``keep``.

    Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2,
    the first ``max_labelled`` of them by a hash of doc_id; null labels are left out,
    and of rows that repeat a doc_id the larger label counts.  A null text is empty;
    it has no features and scores as the clean.  A null doc_id counts as the empty
    text for the remainder.  Without any usable label every score is the prior, 0.05.
    Other columns are not read.  An empty table gives an empty result.
    """
    fold = lambda: F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    docs = documents.select("doc_id", *keep, (fold() == 2).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 2))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    sample = materialise(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "sample")
    hashes, counts, rows = _lexicon(sample, docs, features, voters)
    shared = documents.sparkSession.sparkContext.broadcast(hashes)
    carried = ["doc_id", "held_out", *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    table = materialise(map_texts(docs, _present(shared, carried), f"{kinds}, features array<int>"), "features")
    if len(hashes):
        known = F.coalesce("toxic", F.lit(-1).cast("long")).alias("known")
        labelled = table.select("doc_id", "features").join(F.broadcast(sample), "doc_id", "left")  # at most ``max_labelled`` ids
        patterns = materialise(labelled.groupBy("features", known).agg(F.count(F.lit(1)).cast("double").alias("n")).repartition(_TASKS), "patterns")
        model = _label_model(patterns, counts, rows, len(hashes))

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("features")
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                q = model.posterior(lists.flatten().to_numpy(), row, batch.column("known").to_numpy())
                yield pa.RecordBatch.from_arrays([lists, pa.array(q), batch.column("n")], ["features", "posterior", "n"])

        w, b = _fit(materialise(patterns.mapInArrow(label, "features array<int>, posterior double, n double"), "posteriors"), model, FIT_ROUNDS)
    else:
        w, b = np.zeros(1), float(_logit(min((rows[0] + 1) / (sum(rows) + 20), 0.05)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            f, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[f], minlength=batch.num_rows), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*carried, "score", "predicted"]
            )

    return table.mapInArrow(score, f"{kinds}, score double, predicted int").select("doc_id", "held_out", "score", "predicted", *keep)
