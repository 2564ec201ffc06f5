"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round ``i < t`` every shingle is
placed in a hashed bin with a value in [i, i+1); in round ``t + j`` every shingle
goes to bin ``j``.  Each bin keeps its least value and the rounds end once every
bin is filled, so all ``t`` coordinates are defined after at most ``2t`` rounds,
and the number of equal coordinates of two sketches is concentrated about
``t`` times their Jaccard similarity.

Links.  Documents whose sketches agree in one of ``bands`` bands of ``rows``
coordinates share a bucket (at similarity 0.85, 28 bands of 6 miss 2 pairs in
10**6; at 0.5, 36 pairs in 100 share one).  Texts with equal shingle sets are one class and take part once.  In each
bucket every class is verified on its full set against the least class.  Buckets
that then still hold several components are searched exhaustively: their members
are cut into chunks, and pairs of chunks are compared inside tasks by an exact
sparse product which returns only links that join components.  So no bucket is
capped, no bucket's pairs are emitted, and no link between buckets' members is
lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textkernel import grouped, list_array, lower_ascii, mix, slices, span_hashes, texts_of, words
from .workspace import map_texts, materialise

BANDS, ROWS = 28, 6
CHUNK_SETS, CHUNK_SHINGLES = 1024, 500_000
_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long"


def shingle_sets(part: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row, ascending, and their offsets.

    A row with fewer words than ``width`` has its whole sequence as one shingle,
    a row without words has none.
    """
    n = len(at) - 1
    low = lower_ascii(part)
    starts, ends, row = words(low, at)
    h = span_hashes(low, starts, ends)
    first = grouped(row, n)
    count = np.diff(first)
    take = np.where(count == 0, 0, np.minimum(count, width))  # words in one shingle of this row
    out_h, out_row = [], []
    for k in range(1, width + 1):
        rows = np.flatnonzero((take == k) & ((count == k) | (k == width)))
        if not len(rows):
            continue
        per = count[rows] - k + 1
        begin = np.repeat(first[rows], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        s = np.full(len(begin), np.uint64(k), dtype=np.uint64)
        for j in range(k):
            s = mix(s * np.uint64(0xA24BAED4963EE407) + h[begin + j])
        out_h.append(s)
        out_row.append(np.repeat(rows, per))
    if not out_h:
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    s, r = np.concatenate(out_h), np.concatenate(out_row)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[keep], grouped(r[keep], n)


def sketches(values: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``t`` 64-bit coordinates for each set; sets must not be empty."""
    n = len(offsets) - 1
    full = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    open_rows = np.arange(n)
    for i in range(2 * t):
        size = np.diff(offsets)[open_rows]
        pick = np.repeat(offsets[open_rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        h = mix(values[pick], salt=i + 1)
        place = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if i < t else np.full(len(h), i - t, dtype=np.uint64)
        value = (np.uint64(i) << np.uint64(48)) | (mix(h, salt=7) >> np.uint64(16))
        np.minimum.at(full, np.repeat(open_rows, size) * t + place.astype(np.int64), value)
        open_rows = open_rows[(full.reshape(n, t)[open_rows] == np.iinfo(np.uint64).max).any(axis=1)]
        if not len(open_rows):
            break
    return full.reshape(n, t)


def _kernel(width: int, bands: int, rows: int, out: str):
    """``bands``: id, set size, signature and band keys; ``sets``: id, signature and the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                values, off = shingle_sets(part, at, width)
                n, size = b - a, np.diff(off)
                sums = []
                for salt in (101, 102):  # two order-free sums of mixed members name a set
                    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(values, salt))))
                    sums.append(mix(total[off[1:]] - total[off[:-1]] + size.astype(np.uint64), salt).view(np.int64))
                if out == "sets":
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(a, n), list_array(values.view(np.int64), off, pa.int64())], ["doc_id", "shingles"],
                    )
                    continue
                keys = np.zeros((n, bands), dtype=np.uint64)
                filled = np.flatnonzero(size)
                if len(filled):
                    sketch = sketches(values, np.concatenate(([0], np.cumsum(size[filled]))), bands * rows)
                    for k in range(bands):
                        key = np.full(len(filled), np.uint64(k + 1), dtype=np.uint64)
                        for j in range(k * rows, (k + 1) * rows):
                            key = mix(key * np.uint64(0xA24BAED4963EE407) + sketch[:, j])
                        keys[filled, k] = key
                lists = list_array(keys.reshape(-1).view(np.int64), np.arange(n + 1) * bands, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, n), pa.array(size, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists],
                    ["doc_id", "n_shingles", "s1", "s2", "keys"],
                )

    return run


def _search_chunks(num: int, den: int):
    """Exact comparison of the sets of two chunks; returns links that join different components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("node").to_numpy()
        label = table.column("component").to_numpy()
        left = table.column("side").to_numpy() == 0
        lists = table.column("shingles").combine_chunks()
        off = lists.offsets.to_numpy()
        off = off - off[0]
        size = np.diff(off)
        tokens, inverse, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        column = np.full(len(tokens), -1)
        shared = np.flatnonzero(count > 1)
        column[shared] = np.arange(len(shared))
        row = np.repeat(np.arange(len(ids)), size)
        col = column[inverse]
        row, col = row[col >= 0], col[col >= 0]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        one = bool(left.all())
        li, ri = np.flatnonzero(left), np.arange(len(ids)) if one else np.flatnonzero(~left)
        pos = np.zeros(len(ids), dtype=np.int64)
        pos[ri] = np.arange(len(ri))
        lpos = np.zeros(len(ids), dtype=np.int64)
        lpos[li] = np.arange(len(li))
        both = np.zeros((len(li), len(ri)), dtype=np.float32)
        for lo in range(0, len(shared), 4096):
            a, b = np.searchsorted(col, [lo, lo + 4096])
            r, c = row[a:b], col[a:b] - lo
            x = np.zeros((len(li), 4096), dtype=np.float32)
            y = np.zeros((len(ri), 4096), dtype=np.float32)
            in_l = left[r]
            x[lpos[r[in_l]], c[in_l]] = 1
            in_r = np.ones(len(r), dtype=bool) if one else ~in_l
            y[pos[r[in_r]], c[in_r]] = 1
            both += x @ y.T
        inter = both.astype(np.int64)
        union = size[li][:, None] + size[ri][None, :] - inter
        hit = (den * inter >= num * union) & (label[li][:, None] != label[ri][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(hit)):
            p, q = root(int(label[li[i]])), root(int(label[ri[j]]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(ids[li[i]]), int(ids[ri[j]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _open_bucket_links(shared: DataFrame, sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Links that the comparison with each bucket's least member could not see."""
    member = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = materialise(member, "members")
    least = F.min_by("component", "node")  # the component of the bucket's centre
    stats = member.groupBy("band", "key").agg(
        least.alias("core"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
    ).where("lo <> hi AND m > 2")
    once = stats.groupBy("m", "x1", "x2").agg(F.min_by(F.struct("band", "key", "core"), F.struct("band", "key")).alias("s")).select("s.*")
    open_ = materialise(once, "open")
    rows = member.join(open_, ["band", "key"]).join(sets, "node").withColumn("rest", (F.col("component") != F.col("core")).cast("int"))
    n_chunks = member.join(open_, ["band", "key"]).join(sets.select("node", F.size("shingles").alias("n")), "node").withColumn(
        "rest", (F.col("component") != F.col("core")).cast("int")
    ).groupBy("band", "key").agg(*[
        F.greatest(F.ceil(F.sum(F.when(F.col("rest") == r, F.col("n")).otherwise(0)) / CHUNK_SHINGLES), F.ceil(F.sum((F.col("rest") == r).cast("int")) / CHUNK_SETS), F.lit(1)).alias(c)
        for r, c in ((1, "n_rest"), (0, "n_core"))
    ])
    rows = rows.join(n_chunks, ["band", "key"])
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("rest") == 1, F.col("n_rest")).otherwise(F.col("n_core")))
    rows = rows.withColumn("c", own)
    pair = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).alias("side"))
    with_rest = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1),
        lambda j: F.when(F.col("c") <= j, pair(1, F.col("c"), j, 0)).otherwise(pair(1, j, F.col("c"), 1)),
    )
    with_core = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_core") - 1), lambda j: pair(0, F.col("c"), j, 0))
    as_core = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1), lambda j: pair(0, j, F.col("c"), 1))
    tasks = rows.withColumn("t", F.explode(F.when(F.col("rest") == 1, F.concat(with_rest, with_core)).otherwise(as_core)))
    tasks = tasks.select("band", "key", "t.*", "node", "component", "shingles")
    return tasks.groupBy("band", "key", "kind", "i", "j").applyInArrow(_search_chunks(num, den), "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 3, threshold: float = 0.85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``.

    Null and empty texts and texts without words have no shingles and are linked
    with nothing.  Rows that repeat a doc_id are one document, linked to whatever
    any of its texts is linked to (their number is the only thing gathered by id).  A row without doc_id is never a copy: its
    component_id is null and it is kept.  Other columns are not read.  An empty
    table gives an empty result.
    """
    num, den = round(threshold * 100), 100
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialise(map_texts(docs, _kernel(width, bands, rows, "bands"), f"{_SCHEMA}, keys array<long>"), "sketches")
    filled = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "classes")
    places = classes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = materialise(
        places.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets", merge=True
    )
    shared = materialise(places.join(buckets, ["band", "key"]).select("band", "key", "node", "centre"), "shared", merge=True)
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = map_texts(docs.join(wanted, "doc_id", "left_semi"), _kernel(width, bands, rows, "sets"), "doc_id long, shingles array<long>")
    sets = materialise(sets.select(F.col("doc_id").alias("node"), "shingles"), "sets")
    pairs = shared.where("node <> centre").select("node", "centre").distinct()
    left = sets.select("node", F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("y"))
    inter = F.size(F.array_intersect("x", "y"))
    star = materialise(
        pairs.join(left, "node").join(right, "centre").withColumn("i", inter)
        .where(F.lit(den) * F.col("i") >= F.lit(num) * (F.size("x") + F.size("y") - F.col("i")))
        .select(F.col("centre").alias("a"), F.col("node").alias("b")), "star", merge=True,
    )
    labels = materialise(connected_components(star), "labels")
    more = _open_bucket_links(shared.select("band", "key", "node"), sets, labels, num, den)
    named = base.where("n_shingles > 0 AND doc_id IS NOT NULL").join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node")
    ids = materialise(named.groupBy("doc_id").agg(F.min("node").alias("node"), F.collect_set("node").alias("nodes")), "ids")
    repeated = ids.where(F.size("nodes") > 1).select(F.col("node").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
    extra = materialise(more.unionByName(repeated), "extra", merge=True)
    if extra.limit(1).count():
        labels = connected_components(extra.unionByName(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    found = ids.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    out = base.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
