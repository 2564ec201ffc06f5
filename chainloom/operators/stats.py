"""Observed and expected counts, tests, intervals, compositions, histograms and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.distributions import chi_square_tail, t_quantile


def class_counts(df: DataFrame, keys: list[str], label: Column, classes: list) -> DataFrame:
    """One column ``obs_<class>`` for each class, counted in one aggregate."""
    return df.groupBy(*keys).agg(*[F.count_if(label == c).alias(f"obs_{c}") for c in classes])


def expected_counts(counts: DataFrame, family: str, classes: list) -> DataFrame:
    """Add ``exp_<class>``: a leaf's share of its family times the family's count of the class."""
    of = Window.partitionBy(family)
    row = sum((F.col(f"obs_{c}") for c in classes[1:]), F.col(f"obs_{classes[0]}"))
    whole = F.sum(row).over(of)
    return counts.withColumns({f"exp_{c}": row.cast("double") / whole * F.sum(f"obs_{c}").over(of) for c in classes})


def rollup_counts(df: DataFrame, family: str, leaf: str, label: Column, classes: list) -> DataFrame:
    """Counts of leaves and of families together: grouping sets (family, leaf) and (family)."""
    sets = df.rollup(family, leaf).agg(*[F.count_if(label == c).alias(f"obs_{c}") for c in classes], F.grouping_id().alias("_level"))
    return sets.where("_level < 3").withColumn("level", F.when(F.col("_level") == 0, "leaf").otherwise("family")).drop("_level")


def chi_square_families(counts: DataFrame, family: str, classes: list) -> DataFrame:
    """family, class, x2, df: goodness of fit of each family's leaves against their expected counts; null with one leaf."""
    long = expected_counts(counts, family, classes).select(
        family, F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"obs_{c}").alias("o"), F.col(f"exp_{c}").alias("e")) for c in classes])).alias("s")
    ).select(family, "s.*")
    term = F.when(F.col("e") > 0, (F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e"))
    out = long.groupBy(family, "class").agg(F.sum(term).alias("x2"), (F.count(F.lit(1)) - 1).alias("df"))
    return out.withColumn("x2", F.when(F.col("df") > 0, F.col("x2")))


def chi_square_against(df: DataFrame, family: str, observed: str, expected: str) -> DataFrame:
    """family, x2, df: one column of counts against another over each family's items; families of one item are left out, and x2 is null where nothing is expected of an item."""
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    term = F.when(e > 0, (o - e) * (o - e) / e)
    out = df.groupBy(family).agg(F.sum(term).alias("x2"), F.count(term).alias("_n"), (F.count(F.lit(1)) - 1).alias("df")).where("df > 0")
    return out.select(family, F.when(F.col("_n") == F.col("df") + 1, F.col("x2")).alias("x2"), "df")


def with_p_value(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", F.when(F.col("df") > 0, chi_square_tail("x2", "df")))


def composition(df: DataFrame, slots: Column, buckets: list[str], other: str = "other") -> DataFrame:
    """label, count and share of the labels in an array of slots."""
    label = F.when(F.col("s").isin(*buckets), F.col("s")).otherwise(other)
    counted = df.select(F.explode(slots).alias("s")).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def bucket_composition(df: DataFrame, slots: Column, buckets: dict[str, list[str]]) -> DataFrame:
    """label, count and share of each bucket of labels, empty ones too; labels of no bucket are not counted.  Ascending by count and label."""
    slot = F.explode(slots).alias("s")
    counted = df.select(slot).agg(*[F.count_if(F.col("s").isin(*labels)).alias(f"_{k}") for k, labels in enumerate(buckets.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"_{k}").alias("count")) for k, name in enumerate(buckets)])).alias("r")
    out = counted.select(rows).select("r.*")
    share = F.col("count") / F.nullif(F.sum("count").over(Window.partitionBy()), F.lit(0))  # a row a bucket
    return out.withColumn("share", share).orderBy("count", "label")


def mean_interval(df: DataFrame, values: list[str], keys: list[str] = (), confidence: float = 0.95) -> DataFrame:
    """metric, n, mean, deviation and the t interval's half width, for each column."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values])).alias("s")).select(*keys, "s.*")
    out = long.groupBy(*keys, "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))
    half = t_quantile(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double")) * F.col("deviation") / F.sqrt("n")
    return out.withColumn("half_width", F.when(F.col("n") > 1, half))


def quadrant_counts(df: DataFrame, angle: Column, keys: list[str] = ()) -> DataFrame:
    """Counts in the open quadrants of [0, 360) and their half sums; borders belong to none."""
    q = [F.count_if((angle > a) & (angle < a + 90)).alias(f"q{k + 1}") for k, a in enumerate((0, 90, 180, 270))]
    out = df.groupBy(*keys).agg(*q)
    half = {"right_half": ("q1", "q4"), "left_half": ("q2", "q3"), "upper_half": ("q1", "q2"), "lower_half": ("q3", "q4")}
    return out.withColumns({n: F.col(a) + F.col(b) for n, (a, b) in half.items()})


def equal_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Number of the bin; the last one holds its upper border."""
    return F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """bx, by, count over the range of the data."""
    edge = df.agg(*[f(c).alias(f"_{c}{n}") for c in (x, y) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    cells = df.crossJoin(F.broadcast(edge)).select(*[equal_bin(F.col(c), F.col(f"_{c}lo"), F.col(f"_{c}hi"), bins).alias(n) for c, n in ((x, "bx"), (y, "by"))])
    return cells.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("count"))


def threshold_sweep(df: DataFrame, value: str, positive: Column, low: int, high: int, step: float) -> DataFrame:
    """boundary, accuracy of "above the boundary is positive" for boundaries j * step, low <= j < high.

    Values are first counted by the boundary just below them, so the sweep runs
    over one row for each boundary, not over the data times the boundaries.
    """
    cell = F.greatest(F.least(F.ceil(F.col(value) / step) - 1, F.lit(high - 1)), F.lit(low - 1)).cast("int")  # the last j with value > j * step
    counted = df.where(F.col(value).isNotNull()).groupBy(cell.alias("j")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    grid = df.sparkSession.range(low - 1, high).select(F.col("id").cast("int").alias("j"))
    full = grid.join(counted, "j", "left").na.fill(0, ["p", "n"])
    above, below, all_ = Window.orderBy("j").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    right = F.sum("p").over(above) + F.coalesce(F.sum("n").over(below), F.lit(0))
    return full.select("j", (F.col("j") * step).alias("boundary"), (right / F.sum(F.col("p") + F.col("n")).over(all_)).alias("accuracy")).where(F.col("j") >= low)


def kernel_density(df: DataFrame, value: str, points: int = 50, keys: list[str] = ()) -> DataFrame:
    """x and density on an even grid, a Gaussian kernel with Scott's bandwidth.

    Every value adds to every grid point; the sums are combined within tasks, so ``points``
    rows a key and task are shuffled.  Keys without spread have no density.
    """
    stat = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"), F.stddev_samp(value).alias("_s"))
    stat = stat.where("_s > 0").withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    joined = rows.join(stat, list(keys)) if keys else rows.crossJoin(F.broadcast(stat))  # without keys a single row
    own = [*keys, "_lo", "_hi", "_n", "_h"]
    grid = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("_v")) / F.col("_h")
    return grid.groupBy(*own, "i", "x").agg(F.sum(F.exp(-z * z / 2)).alias("_w")).select(*keys, "i", "x", (F.col("_w") / (F.col("_n") * F.col("_h") * 2.5066282746310002)).alias("density"))


def leaf_and_pair_composition(df: DataFrame, items: str, size: int = 4) -> DataFrame:
    """kind, item, count and frequency: the items of each window, and its adjacent pairs in alphabetical order."""
    at = [F.col(items)[k] for k in range(size)]
    leaves = [F.struct(F.lit("leaf").alias("kind"), x.alias("item")) for x in at]
    pairs = [F.struct(F.lit("pair").alias("kind"), F.concat(F.least(a, b), F.greatest(a, b)).alias("item")) for a, b in zip(at, at[1:])]
    counted = df.select(F.explode(F.array(*leaves, *pairs)).alias("s")).groupBy("s.kind", "s.item").agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("frequency", F.col("count") / F.sum("count").over(Window.partitionBy("kind")))


def balanced_sweep(df: DataFrame, id_: str, label: str, positive: str, value: str, low: int, high: int, step: float, seed: int = 0) -> DataFrame:
    """The threshold sweep over all rows and over a balanced sample, told apart by ``dataset``."""
    from .sampling import balanced_sample

    sets = {"all": df, "balanced": balanced_sample(df, id_, label, seed)}
    runs = [threshold_sweep(d, value, F.col(label) == positive, low, high, step).withColumn("dataset", F.lit(n)) for n, d in sets.items()]
    return runs[0].unionByName(runs[1])
