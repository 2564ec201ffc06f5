"""Joins that need more than an equality: last or first match, rejects with a reason, shifted positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_match(left: DataFrame, right: DataFrame, on: list[str], order: list[Column | str]) -> DataFrame:
    """Left join with the last of the matching rows in ``order``; only that row of each key takes part."""
    return left.join(_one_of(right, on, [F.col(c).desc() if isinstance(c, str) else c.desc() for c in order]), on, "left")


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[Column | str]) -> DataFrame:
    return left.join(_one_of(right, on, [F.col(c).asc() if isinstance(c, str) else c for c in order]), on, "left")


def _one_of(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def split_rejects(left: DataFrame, right: DataFrame, on: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that find a partner, joined, and the others with the reason."""
    return left.join(right, on), left.join(right, on, "left_anti").withColumn("reject_reason", F.lit(reason))


def set_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def aligned(first: DataFrame, second: DataFrame, key: list[str], place1: Column, place2: Column, length: Column) -> DataFrame:
    """Rows of ``first`` and ``second`` whose positions correspond in a match of ``length`` from place1 and place2.

    The match columns come from ``first``'s side; positions are 1-based columns ``pos``.
    """
    shifted = first.where((F.col("pos") > place1) & (F.col("pos") <= place1 + length)).withColumn("_at", F.col("pos") - place1 + place2)
    return shifted.join(second.withColumnRenamed("pos", "_at"), [*key, "_at"]).drop("_at")
