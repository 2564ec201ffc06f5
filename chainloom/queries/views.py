"""The canonical views that the queries work on, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.session import table

#: An ordered categorical event table: chain, pos, family, leaf, state, two class columns and a metric.
RESIDUE_SQL = """residue AS (
  SELECT user_id AS chain, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos,
         upper(substr(event_type, 1, 1)) AS family, upper(substr(event_type, 1, 1)) || CAST(1 + event_id % 5 AS VARCHAR) AS leaf,
         event_type AS state, CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS class3, CAST(json_extract(props, '$.k') AS INTEGER) % 8 AS class8,
         value, event_id
  FROM events)"""

#: Points by chain: the first three coordinates of each vector.
POINT_SQL = """point AS (
  SELECT CAST(label AS BIGINT) AS chain, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS pos, vec_id,
         CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
  FROM embeddings)"""

#: Windows of four consecutive events, as sorted sets.
FOUR_SQL = RESIDUE_SQL + """, four AS (
  SELECT chain, pos, list_sort([leaf, lead(leaf, 1) OVER w, lead(leaf, 2) OVER w, lead(leaf, 3) OVER w]) AS items,
         [family, lead(family, 1) OVER w, lead(family, 2) OVER w, lead(family, 3) OVER w] AS families,
         [state, lead(state, 1) OVER w, lead(state, 2) OVER w, lead(state, 3) OVER w] AS states,
         value, lead(pos, 3) OVER w AS pos4
  FROM residue WINDOW w AS (PARTITION BY chain ORDER BY pos))"""


def residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    family, k = F.upper(F.substring("event_type", 1, 1)), F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("chain"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos"),
        family.alias("family"), F.concat(family, (F.col("event_id") % 5 + 1).cast("string")).alias("leaf"), F.col("event_type").alias("state"),
        (k % 3).alias("class3"), (k % 8).alias("class8"), "value", "event_id",
    )


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    xyz = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return e.select(F.col("label").cast("long").alias("chain"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long").alias("pos"), "vec_id", *xyz)


def four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, pos and arrays of four leaves (sorted), families and states."""
    from chainloom.operators.windows import sliding

    rows = sliding(residue(spark, sf_dir), ["chain"], ["pos"], ["leaf", "family", "state"], 4)
    arrays = {n: F.array(*[F.col(f"{c}{k}") for k in range(1, 5)]) for n, c in (("items", "leaf"), ("families", "family"), ("states", "state"))}
    return rows.select("chain", "pos", F.array_sort(arrays["items"]).alias("items"), arrays["families"].alias("families"), arrays["states"].alias("states"), "value")
