"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
_made: list[str] = []
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="chainloom-"))
        _made.append(_local[0])
    return _local[0]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/chainloom-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, for tasks that write or read own file formats."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def materialise(df: DataFrame, label: str, merge: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and outlives lost executors.

    ``merge`` is for results that are much smaller than what they come from: one more
    shuffle of them lets Spark write files of its advisory size, not one a task.  On
    local file systems Hadoop starts a process for each file's permissions.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    (df.hint("rebalance") if merge else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as ``folder/name``, under a temporary name that is then renamed, and read it back.

    An older one is moved aside, and deleted once the new one is in place.
    """
    spark = df.sparkSession
    where, root = filesystem(folder)
    temporary = f"{name}-{uuid.uuid4().hex}.tmp"
    df.write.parquet(f"{folder}/{temporary}")
    older = None
    if where.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
        older = f"{root}/{name}-{uuid.uuid4().hex}.old"
        where.move(f"{root}/{name}", older)
    where.move(f"{root}/{temporary}", f"{root}/{name}")
    if older:
        where.delete_dir(older)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def map_texts(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over rows that hold texts, in batches of bounded size.

    Spark counts rows, not bytes, when it cuts batches unless it is told a limit, and
    ten thousand long texts are too much for a worker.
    """
    conf = df.sparkSession.conf
    for key, most in _BATCH.items():
        now = int(conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(key, most)
    return df.mapInArrow(function, schema)


@atexit.register
def _clean() -> None:
    for path in _made:
        try:
            where, at = filesystem(path)
            where.delete_dir(at)
        except Exception:  # the folder may never have been written
            continue
