"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

Every window of each benchmark item's size is fingerprinted with a 64-bit SimHash of
its weighted word shingles (the weight is the number of occurrences) and compared with
the items of that size.  Windows within ``RADIUS`` bits that hold a shingle of the item
where a similar one must are kept; their fingerprints are cut into ``RADIUS + 1``
blocks: two fingerprints within ``RADIUS`` bits agree in one block at least, so an
equi-join on (item size, block, value) pairs them with items.  Pairs are then verified
by the exact weighted Jaccard similarity of their shingles.  At similarity 0.8 the
distance is about 10 bits with a deviation of 3; 23 bits are out of reach for one pair
in 10**5 or fewer.

Scale: texts are told apart by a 64-bit hash, and each distinct one is worked on once,
in tasks of about ``TASK`` bytes and pieces of some hundred words.  Work is the words
times the items: blocks of two or three bits don't select, so a window meets all items
of its size, in a broadcast table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise

WIDTH, THRESHOLD, RADIUS, TASK = 5, 0.8, 23, 4 << 20  # TASK: bytes of text whose windows one task takes
TOGETHER = 8  # items whose fingerprints a row holds
_HASHED, _STRICT = "spark.sql.execution.useObjectHashAggregateExec", "spark.sql.ansi.enabled"
_SPACES = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text; null and empty texts have none."""
    bare = F.btrim(F.lower(text), F.lit(_SPACES))
    parts = F.array_remove(F.split(bare, "[\\x20\\x09-\\x0D]+"), "")  # only a text without words has an empty part
    return F.transform(parts, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, k: int) -> Column:
    """Hashes of runs of ``k`` words, from an array column of word hashes."""
    runs = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(runs, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def fingerprints(shingles: DataFrame, key: list[str]) -> DataFrame:
    """SimHash per key of rows (key..., s): a bit is set if most occurrences have it."""
    votes = [F.sum(F.shiftright("s", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    whole = bits[0]
    for bit in bits[1:]:
        whole = whole.bitwiseOR(bit)
    return shingles.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *votes).select(*key, whole.alias("fp"))


def hamming_blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(block, value) for each of ``radius + 1`` blocks of a 64-bit fingerprint."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftright(fp, a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ])


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, key (hash of the text), size (words), k (words in a shingle), m (shingles) and words; items without words are left out."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.xxhash64("text").alias("key"), word_hashes(F.col("text")).alias("words")).withColumn("size", F.size("words")).where("size > 0")
    return items.withColumn("k", F.least(F.col("size"), F.lit(width))).withColumn("m", F.col("size") - F.col("k") + 1)


def _expand(rows: DataFrame, ks: list[int], keep: list[str]) -> DataFrame:
    """Rows (keep..., k, p, s): each shingle of each row's words, for each shingle width in use."""
    out = None
    for k in ks:
        one = rows.select(*keep, F.lit(k).alias("k"), F.posexplode(shingle_hashes(F.col("words"), k)).alias("p", "s"))
        out = one if out is None else out.unionByName(one)
    return out


def _near_windows(texts: DataFrame, prints: DataFrame, grams: DataFrame, threshold: float, radius: int) -> DataFrame:
    """tag, size, span, start, fp, inside (its shingles): windows whose fingerprint is within ``radius`` bits of an item's of that size, less those that cannot be similar.

    ``texts`` has (tag, h), the shingle hashes of each text, and is partitioned by tag;
    ``prints`` (key, size, m, fp) and ``grams`` (key, s) are of items with shingles of
    this width.  Each window of each item's size is fingerprinted: texts are cut into
    pieces that overlap by a window, the votes of 64 bits are summed along each piece
    in lanes of ``w`` longs, and a window's votes are the difference of two sums.  Sums
    may run over, since differences are right modulo 2**64.  Each fingerprint meets the
    items of its size by ``TOGETHER`` in one row.  Then comes an exact check: ``need``
    places of a similar window hold shingles of the item, so one of its first
    ``span - need + 1`` does; most windows hold none of any item there, as a running
    count of such places tells.
    """
    spark = texts.sparkSession
    strict = spark.conf.get(_STRICT)
    try:
        spark.conf.set(_STRICT, "false")  # expressions keep the arithmetic they are made with
        return _near(texts, prints, grams, threshold, radius)
    finally:
        spark.conf.set(_STRICT, strict)


def _near(texts: DataFrame, prints: DataFrame, grams: DataFrame, threshold: float, radius: int) -> DataFrame:
    longest = prints.agg(F.coalesce(F.max("m"), F.lit(1))).first()[0]
    w = next(b for b in (8, 16, 32) if longest <= 1 << (b - 2) or b == 32)
    starts, zero = max(16 * longest, 256), F.lit(0).cast("long")
    ones = sum(1 << i for i in range(0, 64, w))
    each = w + 2  # longs that a place has: its shingle, the lanes and the count of known shingles
    lanes, own = [f"s{j}" for j in range(w)], [f"f{i}" for i in range(TOGETHER)]
    ended = texts.select("tag", F.size("h").alias("n"), F.concat("h", F.array(zero)).alias("h"))  # one place behind the last
    pieces = ended.select("tag", "n", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(starts))).alias("c"))
    places = pieces.select("tag", "n", "c", F.posexplode(F.slice("h", F.col("c") + 1, F.lit(starts + longest))).alias("p", "s"))
    known = F.broadcast(grams.select("s").distinct().withColumn("known", F.lit(1)))
    places = places.join(known, "s", "left").sortWithinPartitions("tag", "c", "p")
    votes = places.select("tag", "n", "c", "p", "s", F.coalesce("known", zero).alias("known"), *[F.shiftright("s", j).bitwiseAND(F.lit(ones)).alias(x) for j, x in enumerate(lanes)])
    before = Window.partitionBy("tag", "c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = votes.select("tag", "n", "c", F.array("s", *[F.coalesce(F.sum(x).over(before), zero) for x in [*lanes, "known"]]).alias("e"))
    sums = sums.groupBy("tag", "c").agg(F.first("n").alias("n"), F.flatten(F.collect_list("e")).alias("e"))  # ``each`` longs a place

    items = prints.join(grams.groupBy("key").agg(F.collect_set("s").alias("grams")), "key")
    items = items.withColumn("row", F.floor((F.row_number().over(Window.partitionBy("size", "m").orderBy("key")) - 1) / TOGETHER))
    items = items.groupBy("size", "m", "row").agg(F.collect_list(F.struct("fp", "grams")).alias("items"))
    items = items.select("size", "m", "items", *[F.coalesce(F.get("items", F.lit(i))["fp"], F.get("items", F.lit(0))["fp"], zero).alias(x) for i, x in enumerate(own)])
    rows = sums.crossJoin(F.broadcast(items)).withColumn("span", F.coalesce(F.least("m", "n"), F.lit(0)))
    need = F.ceil(threshold / (1 + threshold) * (F.col("m") + F.col("span")) - 1e-9).cast("int")
    rows = rows.withColumn("need", need).where("need <= span")  # of texts shorter than the item some are too short
    rows = rows.withColumn("last", F.least(F.col("c") + (starts - 1), F.col("n") - F.col("span")) - F.col("c")).where("last >= 0")
    rows = rows.withColumn("more", (F.lit((1 << (w - 2)) - 1) - F.shiftright("span", 1)) * F.lit(ones)).withColumn("p", F.explode(F.sequence(F.lit(0), "last")))
    rows = rows.withColumn("a", (F.col("p") + F.col("span")) * each).withColumn("b", F.col("p") * each)
    whole = None
    for j in range(w):
        most = (F.get("e", F.col("a") + (j + 1)) - F.get("e", F.col("b") + (j + 1)) + F.col("more")).bitwiseAND(F.lit(ones << (w - 2)))  # this bit of a lane: most shingles vote for it
        most = F.shiftrightunsigned(most, w - 2 - j) if j < w - 1 else F.shiftleft(most, 1)
        whole = most if whole is None else whole.bitwiseOR(most)
    # the partition's number keeps the filters behind the fingerprints: they neither get a copy of them for each item nor come before them
    rows = rows.withColumn("fp", F.coalesce(F.when(F.spark_partition_id() >= 0, whole), zero))

    def near(fp: Column) -> Column:
        return F.bit_count(F.col("fp").bitwiseXOR(fp)) <= radius

    rows = rows.where(reduce(or_, [near(F.col(x)) for x in own]))
    first = F.col("span") - F.col("need") + 1
    rows = rows.where(F.get("e", F.col("b") + first * each + (w + 1)) > F.get("e", F.col("b") + (w + 1)))
    rows = rows.withColumn("item", F.explode("items")).where(near(F.col("item.fp")))
    rows = rows.where(F.arrays_overlap(F.transform(F.sequence(F.lit(0), first - 1), lambda i: F.get("e", F.col("b") + i * each)), F.col("item.grams")))
    inside = F.transform(F.sequence(F.lit(0), F.col("span") - 1), lambda i: F.get("e", F.col("b") + i * each))
    return rows.select("tag", "size", "span", (F.col("c") + F.col("p")).alias("start"), "fp", inside.alias("inside"))


def leaks(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start, similarity: one row for each document and item of which it holds a near copy.

    ``start`` is the first word of the best window, the earliest of equals.  A
    document shorter than the item is one window.  Items with fewer than ``width``
    words are one shingle.  Null and empty texts and items match nothing; rows that
    repeat a doc_id give the best of their windows; rows without doc_id are found
    too, under a null doc_id.  Every distinct item text is searched: items without
    item_id are found under a null item_id, and of texts that repeat an item_id the
    best match is given.  Extra columns are not read.  An empty table gives an empty
    result.
    """
    spark = documents.sparkSession
    named = materialise(_items(benchmark, width), "items")
    items = named.drop("item_id").dropDuplicates(["key"])
    ks = sorted(r[0] for r in items.select("k").distinct().collect()) or [width]  # at most ``width`` values
    grams = materialise(_expand(items, ks, ["key", "size", "m", F.col("k").alias("own")]).where("k = own").drop("own"), "grams")
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    item_prints = materialise(fingerprints(grams, ["key", "size", "k", "m"]), "prints")

    # windows that are near an item by their fingerprints, of all windows of all texts
    many = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // TASK + 1
    texts = docs.select("tag", "text").dropDuplicates(["tag"]).repartition(many, "tag")  # copies are dropped before any shuffle
    words = texts.select("tag", word_hashes(F.col("text")).alias("words"))
    sums, window = spark.conf.get(_HASHED), ["tag", "size", "k", "span", "start"]
    windows = None
    for k in ks:
        part = _near_windows(words.select("tag", shingle_hashes(F.col("words"), k).alias("h")), item_prints.where(F.col("k") == k), grams.where(F.col("k") == k), threshold, radius)
        part = part.withColumn("k", F.lit(k))
        windows = part if windows is None else windows.unionByName(part)
    try:
        spark.conf.set(_HASHED, "false")  # rows come in the order of their groups
        windows = materialise(windows.dropDuplicates(window), "windows")
    finally:
        spark.conf.set(_HASHED, sums)

    # their fingerprints and shingles come with them
    prints = windows.withColumn("b", F.explode(hamming_blocks(F.col("fp"), radius))).select(*window, "fp", "b.*")
    item_prints = item_prints.withColumn("b", F.explode(hamming_blocks(F.col("fp"), radius)))
    item_prints = item_prints.select("key", "size", "k", "m", F.col("fp").alias("item_fp"), "b.*")
    near = prints.join(item_prints, ["size", "k", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select(*window, "key", "m").distinct()

    # exact weighted similarity
    # windows are joined by a shuffle: Spark takes a list for one number, so it would broadcast far more than it thinks
    full = near.join(windows.select(*window, "inside").hint("merge"), window).select(*window, "key", "m", F.explode("inside").alias("s"))
    inside = full.groupBy(*window, "key", "m", "s").agg(F.count(F.lit(1)).alias("cw"))
    wanted = grams.groupBy("key", "k", "s").agg(F.count(F.lit(1)).alias("ci"))
    both = inside.join(wanted, ["key", "k", "s"])
    common = both.groupBy(*window, "key", "m").agg(F.sum(F.least("cw", "ci")).alias("i"))
    similar = common.withColumn("similarity", F.col("i") / (F.col("m") + F.col("span") - F.col("i"))).where(F.col("similarity") >= threshold)
    best = similar.groupBy("tag", "key").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("b"))
    best = materialise(best.join(named.select("item_id", "key").distinct(), "key"), "best")
    best = docs.select("doc_id", "tag").join(best, "tag").groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.at")).cast("long").alias("start"), F.round("b.similarity", 6).alias("similarity"))


def contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``leaks`` of the items that have an item_id; the query and the pipeline take all of them."""
    return leaks(documents, benchmark, width, threshold, radius).where("item_id IS NOT NULL")
