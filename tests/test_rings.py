"""Polygons with holes: areas, nesting, validity and the ground."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.operators import rings
from pixelquarry.operators.neighbourhood import label
from pixelquarry.sources import sinks


@pytest.mark.parametrize("seed", range(12))
def test_rings_hold_exactly_the_pixels(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((14, 17)) < 0.55
    found = rings.nested(rings.traced(mask))
    assert sum(rings.signed_area(r) for *_, r in found) == mask.sum()
    assert all((rings.signed_area(r) < 0) == hole for _, _, hole, r in found)
    inside = np.zeros_like(mask, dtype=int)
    for *_, ring in found:
        inside += np.array([[rings._holds(ring, c + 0.5, r + 0.5) for c in range(17)] for r in range(14)])
    assert ((inside % 2 == 1) == mask).all()
    for _, outer, hole, ring in found:
        corners = [tuple(p) for p in ring[:-1].tolist()]
        assert len(set(corners)) == len(corners)  # no ring meets itself
        if hole:
            own = next(r for n, _, _, r in found if n == outer)
            middle = [(x + 0.5, y + 0.5) for x in range(17) for y in range(14) if rings._holds(ring, x + 0.5, y + 0.5)]
            assert middle and all(rings._holds(own, *p) for p in middle)


def test_shapes_on_the_ground(spark):
    mask = np.zeros((30, 40), dtype=bool)
    mask[2:25, 3:30] = True
    mask[6:12, 8:20] = False  # a hole
    mask[8:10, 10:14] = True  # an island in it
    numbers = label(mask)
    rows = [(1, int(r), int(c), int(numbers[r, c])) for r, c in np.argwhere(numbers > 0)]
    found = rings.rings(spark.createDataFrame(rows, "scene_id int, r int, c int, label int"))
    affine = F.array(*[F.lit(float(x)) for x in (10, 0, 700_000, 0, -10, 2_100_000)])
    shapes = {r.label: r for r in rings.region_shapes(found, affine, F.lit(32643)).collect()}
    for k, shape in shapes.items():
        pixels = int((numbers == k).sum())
        assert shape.pixel_area == pixels and shape.area_m2 == pytest.approx(pixels * 100, rel=2e-3)
    large = json.loads(shapes[numbers[2, 3]].geojson)
    assert shapes[numbers[2, 3]].holes == 1 and [len(p) for p in large["coordinates"]] == [2]
    outer, hole = (np.array(r) for r in large["coordinates"][0])
    assert rings.signed_area(outer) > 0 > rings.signed_area(hole) and (outer[0] == outer[-1]).all()
    whole = sinks.geojson_shapes(rings.region_shapes(found, affine, F.lit(32643)), ["pixel_area", "holes"]).collect()
    features = json.loads(whole[0].geojson)["features"]
    assert len(whole) == 1 and [f["properties"]["id"] for f in features] == sorted(shapes) and features[0]["geometry"]["type"] == "MultiPolygon"
    bare = rings.region_shapes(found, affine, F.lit(None).cast("int")).collect()
    assert all(r.area_m2 is None and "700000" not in r.geojson for r in bare)


def test_ellipsoid_area(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in (*p, p[0])])
    row = spark.range(1).select(rings.ellipsoid_area(ring((0, 0), (1, 0), (1, 1), (0, 1))).alias("cell"), rings.ellipsoid_area(ring((-180, -90), (180, -90), (180, 90), (-180, 90))).alias("earth")).first()
    assert row.cell == pytest.approx(12_308_778_361.469, rel=5e-5)  # with geodesic edges, which bulge
    assert row.earth == pytest.approx(510_065_621_724_089, rel=1e-9)  # the ellipsoid's surface
