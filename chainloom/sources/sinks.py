"""Writers.  All are idempotent: a rerun replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder for each key; only the keys in ``df`` are replaced.

    Rows meet by key first, so a folder gets few files; adaptive execution splits a key that holds many rows over several tasks.
    """
    df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_tsv(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """Text with fixed precision for the columns in ``formats``; nulls become NA."""
    cols = [F.coalesce(F.format_string(formats[c], c) if formats and c in formats else F.col(c).cast("string"), F.lit("NA")).alias(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("sep", "\t").option("emptyValue", "").option("quote", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook's sheets as tables side by side."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One sheet of such a workbook."""
    return spark.read.parquet(f"{path}/{name}")


def save_table(df: DataFrame, name: str, keys: list[str] = ()) -> None:
    """A catalog table, partitioned by entity where one table for each entity would be many."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).saveAsTable(name)


def create_table(spark: SparkSession, name: str, schema: T.StructType, keys: list[str] = ()) -> None:
    """An empty catalog table, unless it is there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f" PARTITIONED BY ({', '.join(f'`{k}`' for k in keys)})" if keys else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{parts}")


def append_rows(df: DataFrame, name: str, keys: list[str]) -> None:
    """Add the rows whose keys the table does not hold yet, so a rerun adds nothing.

    Null keys are equal; of rows that repeat a key the least by the other columns is added.
    """
    known = df.sparkSession.table(name)
    held = known.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [df[k].eqNullSafe(held[f"_{k}"]) for k in keys]
    rest = [c for c in known.columns if c not in keys]
    new = df.join(held, same, "left_anti").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else df.join(held, same, "left_anti").select(*keys).distinct()
    new = new.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    new.select(*known.columns).write.insertInto(name, overwrite=False)


def table_column(df_or_spark, name: str, column: str, where: Column | None = None) -> DataFrame:
    """One column of a catalog table, of one entity if ``where`` says so."""
    rows = df_or_spark.table(name)
    return (rows if where is None else rows.where(where)).select(column)


def route(df: DataFrame, path: str, label: Column, name: str = "class") -> None:
    """Rows to one folder for each label."""
    write_partitioned(df.withColumn(name, label), path, [name])


def split_rejected(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with ``reject_reason``; ``reason`` is null for good ones."""
    marked = df.withColumn("reject_reason", reason)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def na(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias(column)
