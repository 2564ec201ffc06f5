"""Tessellations in blocks against those of one task."""

import numpy as np
import pytest

from chainloom.operators import cells, spatial

SCHEMA = "chain long, pos long, x double, y double, z double"


def rows(xyz, chain):
    return [(chain, k, *map(float, p)) for k, p in enumerate(xyz)]


def chains():
    """Even points, a far grid, a dense cluster with a sparse surround and a line, a plane with a point by it; and flat or short ones."""
    rng = np.random.default_rng(3)
    grid = np.array(list(np.ndindex(6, 6, 6)), dtype=float)[rng.permutation(216)] / 10 + 1000
    clustered = np.vstack((rng.normal(0, 0.01, (150, 3)), rng.normal(0, 5, (40, 3)), np.column_stack([np.linspace(0, 9, 40)] * 3)))
    by_a_plane = np.vstack(([[x, y, 0.5] for x in range(9) for y in range(9)], [[3.5, 3.5, 0.5000001]]))
    flat, short, line = [[x, y, 1] for x in range(5) for y in range(5)], grid[:3], [[k, k, k] for k in range(9)]
    return [rng.random((300, 3)), grid, clustered, by_a_plane, flat, short, line]


@pytest.mark.parametrize("around", [64, 2])
def test_blocks_give_the_cells_of_one_task(spark, monkeypatch, around):
    """Also where most blocks have too many others around them and only ask."""
    monkeypatch.setattr(cells, "_AROUND", around)
    sets = chains() if around > 2 else chains()[1:3]
    data = [r for k, xyz in enumerate(sets) for r in rows(xyz, k)]
    x, y, z = data[7][2:]
    odd = [(0, 900, x, y, z), (0, 901, None, 0.0, 0.0), (1, 902, float("nan"), 0.0, 0.0), (1, 903, float("inf"), 0.0, 0.0)]
    found = cells.tessellate_large(spark.createDataFrame(data + odd, SCHEMA), "chain", size=40)
    assert sorted(map(tuple, found.collect())) == [(k, *c) for k, xyz in enumerate(sets) if len(xyz) > 3 for c in spatial.delaunay(np.array(xyz, dtype=float)).tolist()]


def test_blocks_are_dealt_to_tasks(spark, monkeypatch):
    """A block is slow however few its bytes are, so small blocks are not merged into one task."""
    tasks, write = [], cells.stored

    def spy(df):
        if "certified" in df.columns:
            tasks.append(df.rdd.getNumPartitions())
        return write(df)

    monkeypatch.setattr(cells, "stored", spy)
    cells.tessellate_large(spark.createDataFrame(rows(np.random.default_rng(1).random((60, 3)), 0), SCHEMA), "chain", size=40)
    assert tasks and set(tasks) == {8}


def test_no_rows(spark):
    assert cells.tessellate_large(spark.createDataFrame([], SCHEMA), "chain").count() == 0
