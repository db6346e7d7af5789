"""Scenes of many tiles give what one group gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.operators import mosaic, neighbourhood


def frame(spark, grids):
    rows = [(s, r, c, bool(v)) for s, g in grids.items() for (r, c), v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "scene_id long, r int, c int, mask boolean")


def spiral(n):
    """One thin line that winds through all tiles: the longest chain of links."""
    g = np.zeros((n, n), bool)
    top, left, bottom, right = 0, 0, n - 1, n - 1
    while top <= bottom and left <= right:
        g[top, left : right + 1] = g[top : bottom + 1, right] = g[bottom, left : right + 1] = True
        g[top + 2 : bottom + 1, left] = True
        if left + 1 <= right:
            g[min(top + 2, bottom), left + 1] = True
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    return g


@pytest.fixture(scope="module")
def scenes(spark):
    rng = np.random.default_rng(5)
    grids = {1: rng.random((37, 41)) < 0.4, 2: spiral(33), 3: np.ones((20, 9), bool), 4: np.zeros((5, 5), bool), 5: rng.random((6, 50)) < 0.6}
    return frame(spark, grids)


def rows(df):
    return sorted(tuple(r) for r in df.select("scene_id", "r", "c", df.columns[-1]).collect())


def test_components_of_many_tiles(spark, scenes):
    want = rows(neighbourhood.components(scenes, "mask"))
    for edge in (1, 8, 64):
        assert rows(mosaic.components(scenes, "mask", edge)) == want


def test_cleaning_of_many_tiles(spark, scenes):
    with_nulls = scenes.withColumn("mask", F.when((F.col("r") + F.col("c")) % 11 > 0, F.col("mask")))
    want = rows(neighbourhood.clean_masks(with_nulls.fillna(False), ["mask"], 1, 2, 9).select("scene_id", "r", "c", "mask"))
    assert rows(mosaic.clean_masks(with_nulls, ["mask"], 1, 2, 9, edge=8)) == want
    with pytest.raises(ValueError):
        mosaic.clean_masks(scenes, ["mask"], 1, 2, 9, edge=4)


def test_no_pixels(spark, scenes):
    none = scenes.where("false")
    assert mosaic.components(none, "mask").count() == 0 and mosaic.clean_masks(none, ["mask"], min_area=3).count() == 0


def test_contraction_of_chains_and_hubs(spark):
    rng = np.random.default_rng(2)
    order = [int(x) for x in rng.permutation(60)]
    links = [(1, max(a, b), min(a, b)) for a, b in zip(order, order[1:])] + [(2, k, 0) for k in range(1, 50)] + [(3, 7, 5), (3, 9, 8)]
    found = mosaic.contracted(spark.createDataFrame(links, "scene_id long, a long, b long"))
    assert sorted(tuple(r) for r in found.select("scene_id", "a", "b").collect()) == [(1, k, 0) for k in range(1, 60)] + [(2, k, 0) for k in range(1, 50)] + [(3, 7, 5), (3, 9, 8)]
