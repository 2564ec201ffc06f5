"""Strand geometry: from residues to angle and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions import geometry as G
from chainloom.functions.lookup import HYDROPATHIES, VOLUME
from chainloom.operators import windows


def four_runs(residues: DataFrame, state: Column, key: str = "chain_id", order: str = "res_num") -> DataFrame:
    """Windows of four rows that all have the state, with points p1..p4, leaves and edges."""
    rows = residues.withColumns({"p": F.struct("x", "y", "z"), "hit": state.cast("int")})
    four = windows.sliding(rows.select(key, order, "p", "hit", "leaf"), [key], [order], ["p", "hit", "leaf", order], 4)
    four = four.where(" + ".join(f"hit{k}" for k in range(1, 5)) + " = 4")
    return G.tetra_metrics(four, [f"p{k}" for k in range(1, 5)])


def strand_features(four: DataFrame) -> DataFrame:
    """The 32 columns of a strand: sorted edges and their mean, metrics, property features, angles."""
    edges = F.array(*[f"e{k}" for k in range(1, 7)])
    df = G.strand_angles(four, [f"p{k}" for k in range(1, 5)]).withColumn("_e", F.array_sort(edges))
    families = [F.substring(f"leaf{k}", 1, 1) for k in range(1, 5)]
    cols = {f"E{k + 1}": F.col("_e")[k] for k in range(6)} | {"Ave": F.aggregate("_e", F.lit(0.0), lambda t, x: t + x) / 6}
    return df.select(
        *[c.alias(n) for n, c in cols.items()], F.col("tetrahedrality").alias("Tetrahedrality"), F.col("volume").alias("Volume"),
        *[c.alias(n) for n, c in G.property_features(families, VOLUME, HYDROPATHIES).items()], F.col("rotation").alias("Rotation"), F.col("bend").alias("Bend"), F.col("twist").alias("Twist"),
    )


def rotation_label(rotation: Column, half: float = 180.0) -> Column:
    """Big above half a turn, Small below, the number itself at half a turn."""
    return F.when(rotation > half, "Big").when(rotation < half, "Small").otherwise(rotation.cast("string"))
