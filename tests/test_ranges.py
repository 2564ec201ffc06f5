"""Windows, runs and ranks over blocks against the plain ones; one chain holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chainloom.operators import ml, ranges, sampling, windows

PART, ORDER = ["chain"], ["pos"]


@pytest.fixture(scope="module")
def chains(spark):
    """One chain has nine tenths of the rows; some runs are longer than a block, values and chains may be null."""
    rng = random.Random(3)
    rows = []
    for chain, n in ((1, 900), (None, 40), (2, 30), (3, 1), (4, 29)):
        v, pos = "a", 0
        while pos < n:
            v = rng.choice([x for x in ("a", "b", None) if x != v])
            for _ in range(min(rng.choice([1, 2, 3, 9, 30, 120]), n - pos)):
                rows.append((chain, pos * 2, v, len(rows)))
                pos += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "chain int, pos long, state string, id long").repartition(5).cache()


def rows_of(df):
    names = sorted(df.columns)
    return sorted(map(repr, df.select(*names).collect()))


@pytest.mark.parametrize("size", [16, 61, 1000, 1 << 20])
def test_same_as_plain_windows(chains, size):
    flag = F.coalesce(F.col("state") == "a", F.lit(False))
    for f in (
        lambda **k: windows.run_dedupe(chains, PART, ORDER, "state", **k),
        lambda **k: windows.sliding(chains, PART, ORDER, ["pos", "state"], 4, **k),
        lambda **k: windows.context_frame(chains, PART, ORDER, flag, 4, 3, 3, **k),
        lambda **k: windows.islands(chains, PART, ORDER, "state", "pos", **k),
        lambda **k: windows.sequence_summary(chains, PART, "pos", {"state": "states", "id": "ids"}, "-", **k),
    ):
        assert rows_of(f(size=size)) == rows_of(f())


def test_no_block_is_long(chains):
    """Blocks have their size and the rows that frames need, though one chain holds most rows."""
    counts = ranges.blocks(chains, [*PART, *ORDER], 3, 6, 100).groupBy("_block").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).collect()
    assert sum(r.own == 100 for r in counts) == 10 and all(r.own in (0, 100) and r.n <= 109 for r in counts)  # copies may go behind the last block


def test_ranks(chains):
    got = {r.id: r.at for r in ranges.ranked(chains, [*PART, *ORDER], "at").collect()}
    order = sorted(chains.collect(), key=lambda r: (r.chain is not None, r.chain or 0, r.pos))
    assert got == {r.id: k for k, r in enumerate(order)}


def test_frames_beyond_a_block(chains):
    with pytest.raises(ValueError):
        windows.sliding(chains, PART, ORDER, ["pos"], 40, size=16)


def test_empty(spark, chains):
    for size in (None, 16):
        assert windows.islands(chains.limit(0), PART, ORDER, "state", "pos", size=size).count() == 0
        assert windows.run_dedupe(chains.limit(0), PART, ORDER, "state", size=size).count() == 0


def test_many_labels(chains):
    one, two = (sampling.label_encode(chains, "pos", "code", many=m).select("id", F.col("code").cast("long")) for m in (False, True))
    assert rows_of(one) == rows_of(two)


def test_smoothing_in_blocks(spark):
    curve = spark.createDataFrame([(k / 7, (k * 37 % 11) / 11) for k in range(200)], "x double, y double")
    whole = {r.x: r.smoothed for r in ml.smooth_gaussian(curve, "x", "y").collect()}
    parts = {r.x: r.smoothed for r in ml.smooth_gaussian(curve, "x", "y", size=23).collect()}
    assert whole.keys() == parts.keys() and all(parts[x] == pytest.approx(y) for x, y in whole.items())
    w = Window.orderBy("x")
    k = [2.718281828459045 ** (-(d * d) / 8) for d in range(9)]
    plain = curve.withColumn("n", F.collect_list("y").over(w.rowsBetween(-8, 8))).where("x > 2 AND x < 20").collect()
    for r in plain:
        assert parts[r.x] == pytest.approx(sum(k[abs(i - 8)] * y for i, y in enumerate(r.n)) / (k[0] + 2 * sum(k[1:])))
