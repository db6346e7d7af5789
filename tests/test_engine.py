"""The engine on pairs: what is compared, what is refused, and what a report holds."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.engine import Engine, Refused, Scene
from pixelquarry.sources.sinks import RecordStore

BANDS = ["blue", "green", "red", "nir", "swir1"]
WATER, LAND = (0.06, 0.08, 0.05, 0.02, 0.01), (0.05, 0.08, 0.06, 0.40, 0.20)


def lake(spark, scene_id, filled, height=40, width=40, seed=1):
    """Ground whose left half is a lake, or the lake drained."""
    rng, ground = np.random.default_rng(seed), np.random.default_rng(7).random((40, 40))
    rows = []
    for r in range(height):
        for c in range(width):
            base = WATER if filled and c < width // 2 else LAND
            texture = 0.02 * ground[r * 40 // max(height, 40) // 3, c * 40 // max(width, 40) // 3]
            rows.append((scene_id, r, c, *[float(v + texture + n) for v, n in zip(base, rng.normal(0, 0.0015, 5))]))
    return spark.createDataFrame(rows, "scene_id long, r int, c int, " + ", ".join(f"{b} double" for b in BANDS))


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def test_pictures_of_two_identifiers_are_a_pair(spark, engine):
    pair = [Scene(lake(spark, 1, True), BANDS, pixel_area=100.0), Scene(lake(spark, 2, False, seed=2), BANDS, pixel_area=100.0)]
    answer = engine.analyze("what has changed?", pair)
    assert 47 < float(answer.text.split("%")[0]) < 53
    report = answer.report.first()
    assert report.scene_id == 1 and "not_georeferenced" in report.warnings and report.status == "partial"
    assert 0 <= report.score <= 1 and report.limiting_factor in {"evidence_strength", "registration", "threshold_quality", "semantic_attribution", "warnings", "input_quality"}
    assert report.level in {"high", "medium", "low", "insufficient"} and len(report.reasons) >= 4
    assert [s.step for s in report.steps] == ["inputs", "route", "change-vqa"] and all(s.ms >= 0 for s in report.steps)
    assert {e.type for e in report.evidence} == {"observation", "quality", "measurement"} and report.id.endswith("-1")


def test_pairs_that_cannot_be_compared_are_refused(spark, engine):
    whole = Scene(lake(spark, 1, True), BANDS)
    with pytest.raises(Refused) as refused:
        engine.analyze("what has changed?", [whole, Scene(lake(spark, 1, False, width=20), BANDS)])
    assert refused.value.code == "DIMENSION_MISMATCH"
    left = lake(spark, 1, True).withColumns({b: F.when(F.col("c") < 20, F.col(b)) for b in BANDS})
    right = lake(spark, 1, False).withColumns({b: F.when(F.col("c") >= 20, F.col(b)) for b in BANDS})
    with pytest.raises(Refused) as refused:
        engine.analyze("what has changed?", [Scene(left, BANDS), Scene(right, BANDS)])
    assert refused.value.code == "NO_JOINT_PIXELS"
    with pytest.raises(Refused) as refused:
        engine.analyze("what has changed?", [whole, Scene(lake(spark, 1, False).withColumnRenamed("nir", "vv"), ["vv"])])
    assert refused.value.code == "MISSING_BAND"
    two = lake(spark, 1, True).unionByName(lake(spark, 2, True))
    with pytest.raises(Refused) as refused:
        engine.analyze("what has changed?", [Scene(two, BANDS), Scene(lake(spark, 1, True), BANDS)])
    assert refused.value.code == "PAIR_UNMATCHED"
    far = Scene(lake(spark, 1, True), BANDS, affine=(10.0, 0.0, 900_000.0, 0.0, -10.0, 10.0), epsg=32643)
    near = Scene(lake(spark, 1, True), BANDS, affine=(10.0, 0.0, 700_000.0, 0.0, -10.0, 10.0), epsg=32643)
    for other, code in ((near, "NO_SPATIAL_OVERLAP"), (Scene(near.pixels, BANDS, affine=near.affine, epsg=3857), "UNSUPPORTED_CRS")):
        with pytest.raises(Refused) as refused:
            engine.analyze("what has changed?", [far, other])
        assert refused.value.code == code


def test_placed_pairs_are_brought_on_one_grid(spark, engine):
    one = Scene(lake(spark, 1, True), BANDS, pixel_area=100.0, affine=(10.0, 0.0, 700_000.0, 0.0, -10.0, 400.0), epsg=32643)
    # The same ground drained, in pixels of five metres.
    fine = Scene(lake(spark, 9, False, 80, 80, seed=5), BANDS, pixel_area=25.0, affine=(5.0, 0.0, 700_000.0, 0.0, -5.0, 400.0), epsg=32643)
    answer = engine.analyze("what has changed?", [one, fine])
    share = float(answer.text.split("%")[0])
    assert 45 < share < 55 and "resample" in answer.trace[0]


def test_task_can_be_pinned_and_a_failing_tool_is_passed_over(spark, engine, monkeypatch):
    scene = Scene(lake(spark, 1, True), BANDS, pixel_area=100.0)
    assert engine.analyze("what is the percentage of water", [scene], task="land_cover_analysis").text.startswith("Land cover by share:")

    def broken(query, scenes):
        raise RuntimeError("out of order")

    whole = engine._tools()
    monkeypatch.setattr(engine, "_tools", lambda: whole | {"captioning": broken})
    with pytest.raises(RuntimeError):
        engine.analyze("generate a caption", [scene])


def test_engine_works_outside_the_repository(tmp_path):
    code = """
import sys; sys.path.insert(0, "/root/repo")
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pixelquarry.engine import Engine, Scene
px = spark.range(900).selectExpr("1L AS scene_id", "CAST(id DIV 30 AS INT) AS r", "CAST(id % 30 AS INT) AS c", "0.1D + id % 7 / 50 AS red", "0.1D + id % 5 / 50 AS green", "0.2D + id % 3 / 50 AS blue")
print("SAID", Engine(spark).analyze("what land cover is there?", [Scene(px, ["red", "green", "blue"])]).text)
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code.replace("/root/repo", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "SAID Land cover by share:" in done.stdout, done.stderr[-2000:]


def test_reports_are_kept_under_numbered_identifiers(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "analyses"))
    keeping = Engine(spark, store)
    two = Scene(lake(spark, 1, True).unionByName(lake(spark, 2, True, seed=3)), BANDS, pixel_area=100.0)
    answers = [keeping.analyze("how much water is there?", [two]) for _ in range(2)]
    ids = sorted(r.id for r in store.all().collect())
    assert [i[8:] for i in ids] == ["-000001", "-000002", "-000003", "-000004"] and all(i.startswith("SAT-20") for i in ids)
    last = answers[1].report.orderBy("scene_id").first()
    assert store.get(last.id).first().answer == last.answer == answers[1].text and last.id == ids[2]
