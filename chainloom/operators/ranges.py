"""Ordered rows in ranges of equal length, so that no chain, however long, is one task.

Rows are ranked over the whole table (a range shuffle; only the length of each of its
partitions meets in one place) and cut into blocks of ``size`` ranks.  A block gets
copies of the few rows on either side that a bounded window frame needs, so windows are
exact within blocks; runs without bound are put together from a table of at most two
rows a block.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 1 << 20
BATCH_BYTES = 64 << 20
_ROW_BITS = 33  # monotonically_increasing_id keeps a partition's row number in its low bits
_stored: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="chainloom-ranges-"))
    return "file://" + _local[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that reruns of lost tasks see the same rows."""
    path = f"{_folder(df.sparkSession)}/ranges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` has written for ``df``, which must not be read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python of 64 MiB at most: Spark counts rows, which may be whole tiles, unless it has a limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


@atexit.register
def _clean() -> None:
    for spark, path in _stored:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; a local folder goes below
            break
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)


def ranked(df: DataFrame, order: list[str], name: str = "_rank") -> DataFrame:
    """Add the place (from 0) of each row in the ascending order, nulls first; equal rows in any order, once and for all."""
    kept = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part, row = F.shiftright("_mid", _ROW_BITS), F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    lengths = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = lengths.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + row).drop("_part", "_start", "_mid")


def blocks(df: DataFrame, order: list[str], before: int = 0, after: int = 0, size: int = SIZE) -> DataFrame:
    """Add _rank, _block and _own; rows up to ``before`` ranks in front of a block and ``after`` behind it are copied to it, not its own."""
    if max(before, after) > size:
        raise ValueError("a frame reaches beyond the next block")
    block, place = F.floor(F.col("_rank") / size), F.col("_rank") % size
    here = F.struct(block.alias("b"), F.lit(True).alias("own"))
    back = F.when((place < after) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("own")))
    on = F.when(place >= size - before, F.struct((block + 1).alias("b"), F.lit(False).alias("own")))
    copies = F.array_compact(F.array(here, back, on)) if before or after else F.array(here)
    out = ranked(df, order).withColumn("_to", F.explode(copies))
    return out.withColumns({"_block": F.col("_to.b"), "_own": F.col("_to.own")}).drop("_to")


def owned(df: DataFrame) -> DataFrame:
    """What windows over ``blocks`` gave each row, once."""
    return df.where("_own").drop("_own", "_block", "_rank")


def run_bounds(df: DataFrame, part: list[str], order: list[str], value: str, position: str, size: int = SIZE) -> DataFrame:
    """run_start, run_end and run_length of the maximal run of equal values that each row belongs to; see ``windows.islands``."""
    rows = blocks(df, [*part, *order], size=size)
    inside = Window.partitionBy("_block", *part, value).orderBy("_rank")
    rows = rows.withColumn("_run", F.col("_rank") - F.row_number().over(inside))
    same = Window.partitionBy("_block", *part, value, "_run")
    rows = rows.withColumns({"_s": F.min(position).over(same), "_e": F.max(position).over(same), "_n": F.count(F.lit(1)).over(same), "_first": F.min("_rank").over(same)}).drop("_run")
    last = F.col("_first") + F.col("_n") - 1
    edge = rows.where((F.col("_rank") == F.col("_first")) & ((F.col("_first") % size == 0) | (last % size == size - 1)))
    edge = stored(edge.select(*part, value, "_s", "_e", "_n", "_first"))  # two rows a block at most
    w = Window.orderBy("_first")
    joined = F.lag(last).over(w) + 1 == F.col("_first")
    for c in [*part, value]:
        joined &= F.lag(c).over(w).eqNullSafe(F.col(c))
    chained = edge.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chained.groupBy("_group").agg(F.min("_s").alias("run_start"), F.max("_e").alias("run_end"), F.sum("_n").alias("run_length"))
    found = chained.join(whole, "_group").select("_first", "run_start", "run_end", "run_length")
    out = rows.join(found, "_first", "left")
    out = out.withColumns({"run_start": F.coalesce("run_start", "_s"), "run_end": F.coalesce("run_end", "_e"), "run_length": F.coalesce("run_length", "_n")})
    return owned(out.drop("_s", "_e", "_n", "_first"))
