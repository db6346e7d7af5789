"""Kernels, sources and the engine against small exact cases."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.engine import Engine, Refused, Scene
from pixelquarry.operators import change, geometry, kernels, language, metrics, neighbourhood, projection, radar, registration, thresholds
from pixelquarry.sources import datasets, geotiff, png, sinks
from pixelquarry.streaming.uploads import uploads


def frame(spark, grid, name="x", scene=1):
    rows = [(scene, r, c, float(v)) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, f"scene_id int, r int, c int, {name} double")


def back(df, name, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["r"], r["c"]] = r[name]
    return out


@pytest.mark.parametrize("border,mode", [("replicate", "edge"), ("reflect", "reflect")])
def test_box_mean(spark, border, mode):
    grid = np.random.default_rng(0).random((9, 11))
    padded = np.pad(grid, 2, mode=mode)
    want = np.array([[padded[r : r + 5, c : c + 5].mean() for c in range(11)] for r in range(9)])
    got = back(neighbourhood.box_mean(frame(spark, grid), ["x"], 5, border), "x", grid.shape)
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        neighbourhood.box_mean(frame(spark, grid), ["x"], 4)


def test_labels_and_morphology():
    mask = np.zeros((8, 8), dtype=bool)
    mask[0, 0] = mask[1, 1] = mask[5, 5] = mask[7, :] = True
    assert len(set(neighbourhood.label(mask)[mask])) == 3
    spiral = np.ones((31, 31), dtype=bool)
    for k in range(1, 15, 2):
        spiral[k, k - 1 : 31 - k] = spiral[k : 31 - k, 30 - k] = spiral[30 - k, k : 31 - k] = False
        spiral[k + 2 : 31 - k, k] = False
    assert (neighbourhood.label(spiral) > 0).sum() == spiral.sum()
    assert neighbourhood.ellipse(1) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    square = np.zeros((9, 9), dtype=bool)
    square[2:7, 2:7] = True
    assert (neighbourhood.erode(neighbourhood.dilate(square, neighbourhood.ellipse(1)), neighbourhood.ellipse(1)) == square).all()


def test_components_and_regions(spark):
    grid = np.zeros((6, 7))
    grid[0:2, 0:2] = grid[4:6, 3:7] = 1
    px = frame(spark, grid).withColumn("mask", F.col("x") > 0)
    found = {r.pixel_area: (r.r0, r.c0, r.r1, r.c1, r.area_m2) for r in neighbourhood.regions(px, neighbourhood.components(px, "mask"), "x", 100.0).collect()}
    assert found == {4: (0, 0, 2, 2, 400.0), 8: (4, 3, 6, 7, 800.0)}
    kept = neighbourhood.clean_masks(px, ["mask"], 0, 0, 5).where("mask").count()
    assert kept == 8


def test_otsu_separates_groups_of_scenes(spark):
    rng = np.random.default_rng(1)
    rows = [(s, float(v)) for s, gap in ((1, 5.0), (2, 9.0)) for v in np.concatenate([rng.normal(0, 0.3, 400), rng.normal(gap, 0.3, 400)])]
    df = spark.createDataFrame(rows + [(3, 1.0)] * 20 + [(4, float(i)) for i in range(5)], "scene_id int, x double")
    cut = {r.scene_id: r for r in thresholds.adaptive_threshold(df, "x", ["scene_id"], 0.5).collect()}
    assert 1 < cut[1].threshold < 4 and cut[1].method == "otsu" and 1 < cut[2].threshold < 8
    assert cut[3].method == cut[4].method == "literature" and cut[3].threshold == 0.5
    assert thresholds.otsu(df.limit(0), "x", ["scene_id"]).collect() == []


def test_change_types(spark):
    names = {(b, a): None for b in range(5) for a in range(5)}
    df = spark.createDataFrame(list(names), "b int, a int").withColumn("t", change.change_type(F.col("b"), F.col("a")))
    got = {(r.b, r.a): r.t for r in df.collect()}
    assert got[(2, 1)] == "water_gain" and got[(1, 4)] == "water_loss" and got[(3, 4)] == "urban_loss" and got[(0, 3)] == "other"
    assert all(got[(k, k)] == "spectral_only" for k in range(5)) and None not in got.values()


def test_geometry(spark):
    lon, lat = projection.utm_to_wgs84(F.lit(500000.0), F.lit(0.0), F.lit(31), F.lit(True))
    area = geometry.geodesic_cell_area(F.lit(0.0), 1.0, 1.0)
    row = spark.range(1).select(lon.alias("lon"), lat.alias("lat"), area.alias("area")).first()
    assert row.lon == pytest.approx(3.0) and row.lat == pytest.approx(0.0)
    assert row.area == pytest.approx(12309e6, rel=1e-3)
    boxes = [(i, float(i % 7 * 11), float(i % 5 * 13), float(i % 7 * 11 + 20), float(i % 5 * 13 + 25)) for i in range(60)]
    scenes = spark.createDataFrame(boxes, "scene_id int, minx double, miny double, maxx double, maxy double")
    want = set()
    for a in boxes:
        for b in boxes:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if a[0] < b[0] and w > 0 and h > 0:
                want.add((a[0], b[0], round(w * h / 500, 6)))
    assert {(r.left, r.right, round(r.overlap, 6)) for r in geometry.overlapping(scenes, 20.0).collect()} == want


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(1000).selectExpr("id AS k", "id % 3 AS s")
    one = {r.k: r.split for r in metrics.stratified_split(df, "k", "s", 0.7, 0.15).collect()}
    two = {r.k: r.split for r in metrics.stratified_split(df.repartition(7), "k", "s", 0.7, 0.15).collect()}
    assert one == two and len(one) == 1000 and list(one.values()).count("train") == 3 * 233


def test_geotiff_round_trip(spark, tmp_path):
    cube = np.arange(6 * 20 * 30, dtype=np.uint16).reshape(6, 20, 30)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(cube, 32643, (700000.0, 2100000.0), 10.0, 5, ["blue", "green", "red", "nir", "swir1", "swir2"]))
    (tmp_path / "b.tif").write_bytes(geotiff.encode(cube[:1].astype(np.float32)))
    (tmp_path / "bad.tif").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "cut.tif").write_bytes(geotiff.encode(cube)[:40])
    meta = {r.path.rsplit("/", 1)[1]: r for r in geotiff.band_roles(geotiff.scan_metadata(spark, str(tmp_path))).collect()}
    assert geotiff.metadata("empty.tif", b"")["error_code"] == "EMPTY_FILE" and meta["bad.tif"].error_code == meta["cut.tif"].error_code == "INVALID_GEOTIFF"
    a = meta["a.tif"]
    assert (a.width, a.height, a.band_count, a.dtype, a.crs_epsg, a.nodata) == (30, 20, 6, "u2", 32643, 5.0)
    assert a.transform == [10.0, 0.0, 700000.0, 0.0, -10.0, 2100000.0] and a.band_roles == ["blue", "green", "red", "nir", "swir1", "swir2"]
    assert meta["b.tif"].band_roles == ["gray"] and meta["b.tif"].crs_epsg is None
    px = geotiff.scan_pixels(spark, str(tmp_path / "a.tif"), 0)
    got = {(r.band, r.r, r.c): r.value for r in px.collect()}
    assert len(got) == cube.size and got[(1, 0, 5)] is None and got[(6, 19, 29)] == cube[5, 19, 29]
    small = geotiff.scan_pixels(spark, str(tmp_path / "a.tif"), 10).where("band = 2").collect()
    assert len(small) == 7 * 10 and {round(r.value, 9) for r in small if (r.r, r.c) == (3, 0)} == {round(float(np.average(cube[1, 8:12, :3], axis=0, weights=[3 / 7, 1, 1, 3 / 7]).mean()), 9)}


def test_upload_stream(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", tmp_path / "cp"
    folder.mkdir()
    (folder / "a.tif").write_bytes(geotiff.encode(np.ones((1, 4, 4), dtype=np.uint8)))
    query = uploads(spark, str(folder)).writeStream.format("memory").queryName("uploads").option("checkpointLocation", str(checkpoint)).start()
    query.processAllAvailable()
    (folder / "b.tif").write_bytes(b"x")
    query.processAllAvailable()
    query.stop()
    assert sorted((r.width, r.error_code) for r in spark.table("uploads").collect() if r.width) == [(4, None)]
    assert spark.table("uploads").count() == 2


def test_png_scan(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (6, 9, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(sinks.png(image))
    (tmp_path / "bad.png").write_bytes(b"GIF89a")
    rows = png.scan_png(spark, str(tmp_path)).collect()
    assert [r.error_code for r in rows if r.error_code] == ["INVALID_FILE"]
    assert {(r.r, r.c): tuple(r["values"]) for r in rows if r.r is not None} == {(r, c): tuple(map(int, image[r, c])) for r in range(6) for c in range(9)}
    # Every row filter, applied by hand.
    h, w, n = image.shape
    x = np.pad(image.astype(int), ((1, 0), (1, 0), (0, 0)))
    left, up, corner = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    off = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
    guesses = [np.zeros_like(up), left, up, (left + up) // 2, np.choose(off.argmin(axis=0), [left, up, corner])]
    body = b"".join(bytes([r % 5]) + ((x[r + 1, 1:] - guesses[r % 5][r]) & 255).astype(np.uint8).tobytes() for r in range(h))
    plain = sinks.png(image)
    start = plain.index(b"IDAT")
    packed = zlib.compress(body)
    made = plain[: start - 4] + len(packed).to_bytes(4, "big") + b"IDAT" + packed + b"\0\0\0\0" + plain[-12:]
    assert (png.decode(made) == image).all()


def test_sinks(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 255, (5, 7)).astype(np.uint8)
    rendered = sinks.render(frame(spark, image), ["x"]).withColumn("uri", sinks.data_uri(F.col("png"))).first()
    data = base64.b64decode(rendered.uri.split(",", 1)[1])
    start = data.index(b"IDAT") + 4
    rows = np.frombuffer(zlib.decompressobj().decompress(data[start:]), np.uint8).reshape(5, 8)[:, 1:]
    assert (rows == image).all()
    grid = np.zeros((4, 4))
    grid[1:3, 1:3] = 1
    px = frame(spark, grid).withColumn("mask", F.col("x") > 0)
    found = neighbourhood.regions(px, neighbourhood.components(px, "mask"), "x", None)
    collection = json.loads(sinks.geojson(found, [10.0, 0.0, 100.0, 0.0, -10.0, 500.0]).first().geojson)
    assert collection["features"][0]["geometry"]["coordinates"][0][0] == [110.0, 490.0]
    page = sinks.html_report(spark.createDataFrame([("<b>&",)], "a string"), ["a"]).first().html
    assert "&lt;b&gt;&amp;" in page
    store = sinks.RecordStore(spark, str(tmp_path / "records"))
    store.append(spark.createDataFrame([("1", "2026-01-01"), ("2", "2026-01-02")], "id string, created_at string"))
    store.append(spark.createDataFrame([("3", "2026-01-03", "new")], "id string, created_at string, note string"))
    assert [r.id for r in store.newest(2).collect()] == ["3", "2"] and store.get("1").first().note is None


def test_datasets(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.tif,x\n\nb.tif\n")
    assert [r.sample_id for r in datasets.text_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.tif", "b.tif"]
    (tmp_path / "q.json").write_text(json.dumps([{"sample_id": "1", "question": "?"}]))
    assert datasets.questions(spark, str(tmp_path / "q.json")).first().question == "?"
    assert datasets.text_list(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "forest").mkdir()
    (tmp_path / "forest" / "1.jpg").write_bytes(b"x")
    assert {r.label for r in datasets.image_folder(spark, str(tmp_path)).collect()} >= {"forest"}


def city(shift=(0, 0), size=(96, 96), seed=3):
    """A plain with blocks in it, moved by (rows, columns)."""
    rng = np.random.default_rng(seed)
    grid = np.zeros((size[0] + 40, size[1] + 40))
    for _ in range(60):
        r, c = rng.integers(0, size[0] + 30), rng.integers(0, size[1] + 30)
        grid[r : r + rng.integers(3, 12), c : c + rng.integers(3, 12)] = rng.random()
    return grid[20 - shift[0] : 20 - shift[0] + size[0], 20 - shift[1] : 20 - shift[1] + size[1]]


def dated(spark, before, after, bands=("x",), scene=1):
    rows = [(scene, d, r, c, *[float(v)] * len(bands)) for d, grid in (("before", before), ("after", after)) for r, row in enumerate(grid) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "scene_id long, date string, r int, c int, " + ", ".join(f"{b} double" for b in bands))


@pytest.mark.parametrize("shift", [(0, 0), (4, -3), (12, 9)])
def test_registration_finds_a_planted_shift(spark, shift):
    pair = dated(spark, city(), city(shift))
    row = registration.coregister(pair, ["x"]).first()
    if shift == (0, 0):
        assert row.method == "none" and row.first.score > 0.95
        return
    assert row.method in ("pyramid", "features") and (row.shift_y, row.shift_x) == pytest.approx((-shift[0], -shift[1]), abs=0.5)
    assert row.last.score > row["first"].score and np.hypot(row.last.offset_x, row.last.offset_y) < 1
    back_again = registration.moved(pair, ["x"], registration.coregister(pair, ["x"])).where("date = 'after' AND x IS NOT NULL").collect()
    inner = [abs(r.x - city()[r.r, r.c]) for r in back_again if 15 < r.r < 80 and 15 < r.c < 80]
    assert np.mean(inner) < 0.05 and len(inner) > 3000


def test_feature_matching_finds_large_shifts():
    from pixelquarry.operators import features

    big = city(seed=5) if min(city(seed=5).shape) >= 150 else np.kron(np.random.default_rng(5).random((60, 60)), np.ones((5, 5)))
    a, b = big[40:200, 60:220], big[75:235, 38:198]  # the second lies 35 rows on and 22 columns back
    right, down, pairs = features.matched_shift(a, b + np.random.default_rng(1).normal(0, 0.01, b.shape))
    assert (right, down) == (22.0, -35.0) and pairs >= features.LEAST_PAIRS
    assert features.matched_shift(a, np.zeros_like(a)) is None and features.matched_shift(a[:20, :20], a[:20, :20]) is None
    assert features.mutual_pairs(np.zeros((0, 4), np.uint64), np.zeros((3, 4), np.uint64)).shape == (0, 2)


def test_registration_rejects_other_ground(spark):
    row = registration.coregister(dated(spark, city(), city(seed=9)), ["x"]).first()
    assert row.method in ("rejected", "pyramid", "features") and row.last.score >= row["first"].score and row.last.ncc < 0.35


def test_resampling_to_another_grid(spark):
    fine = np.add.outer(np.arange(12.0), 2 * np.arange(16.0))
    grid = frame(spark, np.zeros((5, 7)))
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = back(projection.warped(frame(spark, fine), grid, ["x"], array(10, 0, 100, 0, -10, 500), array(20, 0, 110, 0, -20, 490)).fillna(-1.0), "x", (5, 7))
    # The centre of a coarse pixel is the corner that four fine ones share, one row and column in.
    want = np.array([[2 * r + 1.5 + 2 * (2 * c + 1.5) for c in range(7)] for r in range(5)])
    assert np.allclose(got, want)


def test_edges_and_lines():
    image = np.zeros((40, 40))
    image[10:30, 12:28] = 255
    found = kernels.edges(image)
    r, c = np.nonzero(found)
    assert found.any() and ((np.abs(r - 10) <= 1) | (np.abs(r - 29) <= 1) | (np.abs(c - 12) <= 1) | (np.abs(c - 27) <= 1)).all()
    assert not kernels.edges(np.full((20, 20), 7.0)).any()
    assert kernels.line_element(25, 0) == [(0, k) for k in range(-12, 13)] and len(kernels.line_element(25, 90)) == 25
    gx, gy = kernels.sobel(np.tile(np.arange(6.0), (5, 1)))
    assert (gx[:, 1:-1] == 8).all() and (gy == 0).all()


def test_texture_kernels_keep_rows(spark):
    px = frame(spark, city(size=(40, 30)), "nir").withColumn("note", F.lit("n"))
    for out in (kernels.edge_density(px, "nir", "t"), kernels.linear_structure(px, "nir", "t"), kernels.local_deviation(px, "nir", "t")):
        rows = out.collect()
        assert len(rows) == 1200 and all(0 <= r.t <= 1 and r.note == "n" for r in rows) and max(r.t for r in rows) == 1


def test_polygons(spark):
    grid = np.zeros((30, 30), dtype=int)
    grid[2:12, 3:23] = 1
    r, c = np.ogrid[:30, :30]
    grid[(r - 21) ** 2 + (c - 20) ** 2 <= 36] = 2
    grid[20, 2] = 3
    rows = [(1, int(a), int(b), int(grid[a, b])) for a, b in np.argwhere(grid)]
    found = {x.label: x for x in kernels.polygons(spark.createDataFrame(rows, "scene_id int, r int, c int, label int")).collect()}
    assert {(p.r, p.c) for p in found[1].outline} == {(2, 3), (2, 22), (11, 22), (11, 3)} and found[1].rectangularity == pytest.approx(1)
    assert found[2].compactness > 0.8 > found[1].compactness and found[3].compactness is None and len(found[3].outline) == 4


def test_cuts_of_dense_and_sparse_bins_agree(spark):
    """The two ways to an Otsu cut: over all bins, and over those that have values."""
    rng = np.random.default_rng(5)
    rows = [(s, float(v)) for s in range(6) for v in np.round(np.concatenate([rng.normal(0, 1 + s, 200), rng.normal(9, 1, 40 * s)]), s % 3)]
    df = spark.createDataFrame(rows + [(9, None)] * 3, "scene_id int, x double")
    dense = {r.scene_id: (r.threshold, r.quality) for r in thresholds.otsu(df, "x", ["scene_id"]).collect()}
    found = thresholds.adaptive_thresholds(df, [thresholds.Cut("a", F.col("x"), 0.0), thresholds.Cut("b", -F.col("x"), 1.5, True)], ["scene_id"]).collect()
    assert len(found) == 7
    for r in found:
        assert r.a_quality == pytest.approx(dense.get(r.scene_id, (0, 0.0))[1])
        assert r.a == (pytest.approx(dense[r.scene_id][0]) if r.a_method == "otsu" else 0.0)
    assert [(r.a, r.b, r.a_quality) for r in found if r.scene_id == 9] == [(0.0, 1.5, 0.0)]


def test_speckle_report(spark):
    power = np.random.default_rng(0).gamma(4, 0.25, (60, 60))
    row = radar.speckle_report(frame(spark, power), "x").first()
    assert 2.5 < row.enl < 6 and row.cv_after < row.cv_before / 2 and row.reduction > 2


def test_ring_area(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([([{"lon": a, "lat": b} for a, b in ring],), ([{"lon": a, "lat": b} for a, b in reversed(ring)],)], "ring array<struct<lon:double,lat:double>>")
    areas = [r.a for r in df.select(geometry.ring_area(F.col("ring")).alias("a")).collect()]
    assert areas[0] == pytest.approx(areas[1]) == pytest.approx(12364e6, rel=1e-3)


def test_parse_edge_cases(spark):
    said = ["", None, "water " * 300, "lakes near the road", "ships", "north of the water", "rooftops in the top left", "5 ha of water", "no more than 5 ha of water over 2 px", "largest and smallest lakes", "99999999999 largest lakes"]
    rows = {i: r for i, r in enumerate(language.parse_grounding(spark.createDataFrame(list(enumerate(said)), "request_id long, query string")).orderBy("request_id").collect())}
    assert [rows[i].error for i in range(6)] == ["empty", "empty", "too_long", "spatial_relation", "unsupported_object", "spatial_relation"]
    assert (rows[3].refused, rows[4].refused) == ("near", "ships")
    assert (rows[6].target, rows[6].sector, rows[6].frame_relative) == ("built_up", "north_west", True)
    assert rows[7].min_area_m2 is None and rows[7].max_area_m2 is None
    assert rows[8].max_area_m2 == 50_000 and rows[8].min_pixels == 2
    assert rows[9].superlative is None and rows[9].limit is None and rows[10].limit == 1


def test_engine(spark):
    from pixelquarry.sources.scenes import BANDS, pixel_grid, pixel_pair

    sf = "/root/testdata/sf0.001"
    engine, scene = Engine(spark), Scene(pixel_grid(spark, sf), list(BANDS), pixel_area=100.0)
    answer = engine.analyze("what land cover is there?", [scene])
    assert answer.task == "land_cover_analysis" and "vegetation" in answer.text and answer.figures.count() > 1
    radar_scene = Scene(pixel_grid(spark, sf), ["vv"], "sar")
    assert "By both sensors" in engine.analyze("combine optical and sar", [scene, radar_scene]).text
    assert engine.analyze("what is in this image", [scene]).task == "vqa"
    assert "The share of vegetation is" in engine.analyze("tell me what share is vegetation, and what is the percentage", [scene]).text
    assert engine.analyze("generate a caption", [scene]).text.startswith("Vegetation takes")
    found = engine.analyze("show me the 2 largest forests", [scene])
    assert found.task == "grounding" and 1 <= found.figures.count() <= 2 and "of vegetation" in found.text
    assert all(len(r.outline) >= 3 for r in found.figures.collect())
    assert "yet none in the south fits" in engine.analyze("show me the forests in the south", [scene]).text
    with pytest.raises(Refused) as refused:
        engine.analyze("where are the forests over 2 ha", [Scene(pixel_grid(spark, sf), list(BANDS))])
    assert refused.value.code == "NO_GROUND_SIZE"
    pair = [Scene(pixel_pair(spark, sf).where(F.col("date") == d).drop("date"), list(BANDS), pixel_area=100.0) for d in ("before", "after")]
    assert engine.analyze("hello", pair).task == "change_detection"
    assert engine.analyze("how much has changed?", pair).task == "change_vqa"
    with pytest.raises(Refused) as refused:
        engine.analyze("count the ships", [scene])
    assert refused.value.code == "UNSUPPORTED_TASK"
    with pytest.raises(Refused) as refused:
        engine.analyze("where is the water", [radar_scene])
    assert refused.value.code == "WRONG_MODE" or refused.value.code == "MISSING_MODALITY"
    with pytest.raises(Refused):
        engine.analyze("hello", [])
