"""Sessions and tables."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_shipped: set[str] = set()


def session(name: str = "chainloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; pass ``master`` and other settings with dots as underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.master(value) if key == "master" else builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Views for SQL."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors if their Python can't find it by the working folder or PYTHONPATH."""
    root = str(Path(__file__).resolve().parent.parent)
    app = spark.sparkContext.applicationId
    seen = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if app in _shipped or any((Path(p) / "chainloom" / "__init__.py").exists() for p in seen):
        return
    target = tempfile.mkdtemp(prefix="chainloom-ship-")
    shutil.copytree(f"{root}/chainloom", f"{target}/stage/chainloom", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{target}/chainloom", "zip", f"{target}/stage"))
    _shipped.add(app)
