"""Reference systems and warps against known points, round trips and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.operators import projection


def test_known_points_and_round_trips(spark):
    row = spark.range(1).select(projection.reprojected(F.lit(-79.387139), F.lit(43.642567), F.lit(4326), F.lit(32617)).alias("p")).first().p
    assert (row.x, row.y) == pytest.approx((630084.30, 4833438.59), abs=0.02)
    south = spark.range(1).select(projection.reprojected(F.lit(151.2153), F.lit(-33.8568), F.lit(4326), F.lit(32756)).alias("p")).first().p
    assert (south.x, south.y) == pytest.approx((334900, 6252300), abs=150)
    points = [(i, 69 + 0.03 * i, -80 + 0.8 * i, c) for i in range(200) for c in (32643, 32743)]
    rows = spark.createDataFrame(points, "i int, lon double, lat double, epsg int")
    rows = rows.withColumn("p", projection.reprojected(F.col("lon"), F.col("lat"), F.lit(4326), F.col("epsg")))
    for r in rows.withColumn("d", projection.degrees(F.col("p.x"), F.col("p.y"), F.col("epsg"))).collect():
        assert r.d.lon == pytest.approx(r.lon, abs=1e-9) and r.d.lat == pytest.approx(r.lat, abs=1e-9)


def test_unsupported_systems_are_null(spark):
    rows = spark.createDataFrame([(32643, 3857), (None, 32643), (32600, 32643), (32661, 4326), (32643, 32643), (4326, 4326)], "a int, b int")
    got = [r.p for r in rows.select(projection.reprojected(F.lit(1.0), F.lit(2.0), F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[:4] == [None] * 4 and [tuple(p) for p in got[4:]] == [(1.0, 2.0)] * 2
    code = spark.createDataFrame([(-180.0, 1.0), (180.0, -1.0), (77.9, 19.0)], "lon double, lat double").select(projection.utm_code(F.col("lon"), F.col("lat")).alias("c"))
    assert [r.c for r in code.collect()] == [32601, 32760, 32643]


def grid(spark, values, scene=1):
    rows = [(scene, r, c, None if math.isnan(v) else float(v)) for r, row in enumerate(values) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "scene_id int, r int, c int, x double")


def array(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize("nearest", [False, True])
@pytest.mark.parametrize("target", [(13.0, 0.0, 31.0, 0.0, -7.0, 1490.0), (6.0, 3.0, 200.0, 2.0, -9.0, 1200.0), (10.0, 0.0, 0.0, 0.0, -10.0, 1500.0)])
def test_warp_agrees_with_brute_force(spark, target, nearest):
    values = np.random.default_rng(2).normal(size=(150, 131))
    values[40, 50] = np.nan
    affine = (10.0, 0.0, 0.0, 0.0, -10.0, 1500.0)
    wanted = grid(spark, np.zeros((140, 90))).select("scene_id", "r", "c")
    got = {(r.r, r.c): r.x for r in projection.warped(grid(spark, values), wanted, ["x"], array(*affine), array(*target), nearest=nearest).collect()}
    assert len(got) == 140 * 90
    a, b, c, d, e, f = target
    known = 0
    for (r, k), value in got.items():
        x, y = a * (k + 0.5) + b * (r + 0.5) + c, d * (k + 0.5) + e * (r + 0.5) + f
        u, v = x / 10 - 0.5, (1500 - y) / 10 - 0.5
        if nearest:
            u, v = math.floor(u) + (u - math.floor(u) >= 0.5), math.floor(v) + (v - math.floor(v) >= 0.5)
        weights = [((math.floor(v) + i, math.floor(u) + j), (v % 1 if i else 1 - v % 1) * (u % 1 if j else 1 - u % 1)) for i in (0, 1) for j in (0, 1)]
        parts = [(values[p] if 0 <= p[0] < 150 and 0 <= p[1] < 131 else np.nan, w) for p, w in weights if w > 1e-9]
        want = sum(p * w for p, w in parts)
        if np.isnan(want):
            assert value is None
        elif not any(1e-12 < abs(w) < 1e-6 for _, w in parts):
            known += 1
            assert value == pytest.approx(want, abs=1e-6)
    assert known > 5000


def test_warp_between_zones_keeps_the_ground(spark):
    """A smooth field of the ground itself comes back as that field of the new grid's places."""
    affine, target = (10.0, 0.0, 790000.0, 0.0, -10.0, 2103000.0), (12.0, 0.0, 159500.0, 0.0, -12.0, 2103600.0)
    place = lambda t: projection.centre_of(F.col("c"), F.col("r"), array(*t))
    cells = lambda h, w: spark.range(h * w).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / w).cast("int").alias("r"), (F.col("id") % w).cast("int").alias("c"))
    px = cells(200, 260)
    x, y = place(affine)
    px = px.withColumn("lat", projection.degrees(x, y, F.lit(32643))["lat"])
    found = projection.warped(px, cells(150, 150), ["lat"], array(*affine), array(*target), source_epsg=F.lit(32643), target_epsg=F.lit(32644))
    x, y = place(target)
    rows = found.withColumn("want", projection.degrees(x, y, F.lit(32644))["lat"]).where("lat IS NOT NULL").collect()
    assert len(rows) > 1000 and max(abs(r.lat - r.want) for r in rows) < 1e-8
    lost = projection.warped(px, cells(2, 2), ["lat"], array(*affine), array(*target), source_epsg=F.lit(32643), target_epsg=F.lit(3857)).collect()
    assert len(lost) == 4 and all(r.lat is None for r in lost)


def test_pairs_of_two_zones(spark):
    rows = [(1, 32643, 800000.0, 2100000.0, 804000.0, 2103000.0), (2, 32643, 800000.0, 2100000.0, 804000.0, 2103000.0), (3, 32643, 802000.0, 2100000.0, 806000.0, 2103000.0), (4, 9999, 0.0, 0.0, 1.0, 1.0)]
    box = spark.range(1).select(projection.reprojected_box([F.lit(x) for x in rows[0][2:]], F.lit(32643), F.lit(32644)).alias("b")).first().b
    scenes = spark.createDataFrame([*rows, (5, 32644, *box)], "scene_id int, epsg int, minx double, miny double, maxx double, maxy double")
    got = {(r.left, r.right): (round(r.overlap, 2), r.strategy) for r in projection.footprint_pairs(scenes, 0.03).collect()}
    assert got[1, 2] == (1.0, "identical_grid") and got[1, 3] == (0.5, "resample")
    assert got[1, 5][1] == "reproject" and got[1, 5][0] > 0.98 and {k for k in got if 4 in k} == set()


def test_pairs_that_share_slivers(spark):
    """A right scene's box in the left one's system may reach the left one though their boxes in degrees are apart."""
    slivers = {(542, 3613): 0.001971, (3277, 5406): 0.001753, (3360, 3685): 0.000361}
    rows = []
    for k in {k for pair in slivers for k in pair}:
        x, y, other = k * 37 % 997 * 100 + 800000.0, k * 61 % 991 * 100 + 2100000.0, k % 3 == 1
        x -= 631000 if other else 0
        rows.append((k, 32644 if other else 32643, x, y, x + 4000, y + 3000))
    scenes = spark.createDataFrame(rows, "scene_id int, epsg int, minx double, miny double, maxx double, maxy double")
    got = {(r.left, r.right): (round(r.overlap, 6), r.strategy) for r in projection.footprint_pairs(scenes, 0.04).collect()}
    assert {k: got.get(k) for k in slivers} == {k: (v, "incompatible") for k, v in slivers.items()}


def test_pairs_take_no_projection_each(spark):
    """A scene is brought to a system once, and not for each scene that it meets."""
    rows = [(k, 32643 + k % 2, 800000.0 - 631000 * (k % 2), 2100000.0, 804000.0 - 631000 * (k % 2), 2103000.0) for k in range(4)]
    scenes = spark.createDataFrame(rows, "scene_id int, epsg int, minx double, miny double, maxx double, maxy double")
    found = projection.footprint_pairs(scenes, 0.04)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert not any("ATANH" in line for line in plan[: join + 1])
    assert "SortMergeJoin" in found._jdf.queryExecution().sparkPlan().toString()
    assert len(found.collect()) == 6
