"""Where in a scene a request's land cover lies: regions of a class map, chosen by what was asked.

Regions are found once a scene, for all classes and sectors; requests meet them by scene and class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.operators.answers import square_km
from pixelquarry.operators.landcover import CLASSES, code_name
from pixelquarry.operators.neighbourhood import label, per_scene, plane
from pixelquarry.operators.wording import filled

#: sector -> rows and columns as fractions of the frame (fixed values).
SECTORS = {
    "north": (0.0, 0.5, 0.0, 1.0),
    "south": (0.5, 1.0, 0.0, 1.0),
    "east": (0.0, 1.0, 0.5, 1.0),
    "west": (0.0, 1.0, 0.0, 0.5),
    "north_east": (0.0, 0.5, 0.5, 1.0),
    "north_west": (0.0, 0.5, 0.0, 0.5),
    "south_east": (0.5, 1.0, 0.5, 1.0),
    "south_west": (0.5, 1.0, 0.0, 0.5),
    "centre": (0.25, 0.75, 0.25, 0.75),
}
#: Classes whose regions only radar can part, so that their number isn't stated without it.
NEED_RADAR = ("built_up", "bare_soil")
#: Regions of a class that a scene's answer holds, at most: the largest ones.
MOST = 200
#: Why a region is left out, in the order of the tests.
TESTS = ("outside_sector", "below_min_pixels", "above_max_pixels", "area_unknown", "below_min_area", "above_max_area")


def frames(px: DataFrame) -> DataFrame:
    """scene_id, h, w: the size of each scene."""
    return px.groupBy("scene_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def in_sector(sector: Column) -> Column:
    """Whether (r, c) of a frame h by w lies in ``sector``; bounds are rounded half to even."""

    def bound(k: int, size: str) -> Column:
        part = F.coalesce(*[F.when(sector == name, F.lit(b[k])) for name, b in SECTORS.items()])
        return F.bround(part * F.col(size), 0)

    return (F.col("r") >= bound(0, "h")) & (F.col("r") < bound(1, "h")) & (F.col("c") >= bound(2, "w")) & (F.col("c") < bound(3, "w"))


def _labels(codes: np.ndarray) -> np.ndarray:
    """Components of every class, numbered from 1 within each."""
    out = np.zeros(codes.shape, dtype=np.int32)
    for code in CLASSES.values():
        if code:
            out = np.where(codes == code, label(codes == code), out)
    return out.astype(np.int32)


def class_regions(classified: DataFrame, scores: dict[str, Column], min_pixels: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The regions of a class map (scene_id, r, c, class_code), and the label of each of its pixels.

    Regions: scene_id, class, label, pixel_area, bounding box, centroid, score (mean of the class's
    column in ``scores``; null without one), sectors (map: share of its pixels in each), rank and more.
    The ``most`` largest of a class are kept, and none below ``min_pixels``; ``more`` says whether others were left.
    """
    score = F.coalesce(*[F.when(F.col("class_code") == CLASSES[name], s) for name, s in scores.items()], F.lit(None).cast("double"))
    px = classified.select("scene_id", "r", "c", "class_code", score.alias("score"))
    labelled = per_scene(px, ["scene_id"], lambda t: {"label": _labels(plane(t, "class_code", 0.0))}, {"label": "int"}).where("label > 0")
    placed = labelled.join(frames(px), "scene_id")
    inside = [x for name in SECTORS for x in (F.lit(name), F.count_if(in_sector(F.lit(name))) / F.count("*"))]
    found = placed.groupBy("scene_id", "class_code", "label").agg(
        F.count("*").alias("pixel_area"),
        F.min("c").alias("c0"), F.min("r").alias("r0"), (F.max("c") + 1).alias("c1"), (F.max("r") + 1).alias("r1"),
        F.avg("c").alias("centroid_c"), F.avg("r").alias("centroid_r"),
        F.avg("score").alias("score"), F.create_map(*inside).alias("sectors"),
    ).where(F.col("pixel_area") >= min_pixels)
    order = Window.partitionBy("scene_id", "class_code").orderBy(F.col("pixel_area").desc(), "label")
    several = Window.partitionBy("scene_id", "class_code")
    ranked = found.withColumns({"rank": F.row_number().over(order), "more": F.count("*").over(several) > most}).where(F.col("rank") <= most)
    named = lambda df: df.withColumn("class", code_name(F.col("class_code"))).drop("class_code")
    return named(ranked), named(labelled.drop("score"))


def admitted(requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """``requests`` (parsed, with scene_id) beside their scene, and the error that its geometry gives.

    ``scenes`` has scene_id, georeferenced, north_up and pixel_area (null: unknown). A compass sector
    other than the centre needs north up; a bound in ground units needs a georeference.
    """
    compass = F.col("sector").isNotNull() & ~F.col("frame_relative") & (F.col("sector") != "centre")
    ground = F.col("min_area_m2").isNotNull() | F.col("max_area_m2").isNotNull()
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("georeferenced").isNull(), "no_scene")
    error = error.when(compass & ~F.col("north_up"), "not_north_up").when(ground & ~F.col("georeferenced"), "no_ground_size")
    return requests.join(scenes, "scene_id", "left").withColumn("error", error)


def once(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that ask the same of the same scene, once; and request_id, asked_as of all of them.

    Of equal ones the first identifier stands for all, so regions are judged for each thing that is
    asked and not for each request. Join what is found by it back with ``asked_as``.
    """
    facts = [c for c in admitted.columns if c not in ("request_id", "query")]
    keyed = admitted.select("request_id", F.sha2(F.to_json(F.struct(*facts)), 256).alias("_same"), F.struct(*facts).alias("_f"))
    first = keyed.groupBy("_same").agg(F.min("request_id").alias("asked_as"), F.min_by("_f", "request_id").alias("_f"))
    members = keyed.select("request_id", "_same").join(first.select("_same", "asked_as"), "_same").drop("_same")
    return first.select(F.col("asked_as").alias("request_id"), "_f.*"), members


def judged(admitted: DataFrame, regions: DataFrame) -> DataFrame:
    """A row for each admitted request and region of its class, with sector_overlap, area_m2, why it
    is left out (null: it isn't) and place among those that are kept.

    Kept regions are those with more than half of their pixels in the sector and within the bounds,
    in order of size (largest first unless the smallest are asked for), ties by label; those past
    the limit are left out as ``beyond_limit``.
    """
    pairs = admitted.where("error IS NULL").join(regions, (admitted["scene_id"] == regions["scene_id"]) & (F.col("target") == F.col("class"))).drop(regions["scene_id"])
    overlap = F.when(F.col("sector").isNotNull(), F.try_element_at("sectors", F.col("sector")))
    pairs = pairs.withColumns({"area_m2": F.col("pixel_area") * F.col("pixel_area_m2"), "sector_overlap": overlap})
    n, area = F.col("pixel_area"), F.col("area_m2")
    bounded = F.col("min_area_m2").isNotNull() | F.col("max_area_m2").isNotNull()
    tests = (
        F.col("sector_overlap") <= 0.5, n < F.col("min_pixels"), n > F.col("max_pixels"), bounded & area.isNull(),
        area < F.col("min_area_m2"), area > F.col("max_area_m2"),
    )
    out = F.coalesce(*[F.when(test, name) for name, test in zip(TESTS, tests, strict=True)])
    pairs = pairs.withColumn("left_out", out)
    size = F.when(F.col("superlative") == "smallest", n).otherwise(-n)
    order = Window.partitionBy("request_id", F.col("left_out").isNull()).orderBy(size, "label")
    pairs = pairs.withColumn("place", F.when(F.col("left_out").isNull(), F.row_number().over(order)))
    return pairs.withColumn("left_out", F.when(F.col("place") > F.col("limit"), "beyond_limit").otherwise(F.col("left_out")))


def answers(admitted: DataFrame, found: DataFrame, classes: DataFrame, parted: DataFrame | None = None) -> DataFrame:
    """One row a request: error, regions, selected_pixels, selected_area_m2, class_pixels, coverage,
    how many regions each test left out, count_reportable and the answer.

    ``classes`` has scene_id, class, class_pixels and frame_pixels of the class map. ``parted`` has
    scene_id and radar_parts of fused scenes: whether radar told bright echoes from the rest there, so that
    regions which only it can part may be counted.
    """
    kept = F.col("left_out").isNull()
    totals = found.groupBy("request_id").agg(
        F.count_if(kept).alias("regions"),
        F.sum(F.when(kept, F.col("pixel_area"))).alias("selected_pixels"),
        F.sum(F.when(kept, F.col("area_m2"))).alias("selected_area_m2"),
        *[F.count_if(F.col("left_out") == name).alias(name) for name in (*TESTS, "beyond_limit")],
    )
    classes = classes.withColumnsRenamed({"class": "_class", "scene_id": "_scene"})
    rows = admitted.join(totals, "request_id", "left").join(classes, (F.col("scene_id") == F.col("_scene")) & (F.col("target") == F.col("_class")), "left")
    if parted is not None:
        rows = rows.join(parted.select(F.col("scene_id").alias("_scene2"), "radar_parts"), F.col("scene_id") == F.col("_scene2"), "left")
    zero = {n: 0 for n in ("regions", "selected_pixels", "class_pixels", *TESTS, "beyond_limit")}
    rows = rows.fillna(zero).withColumns(
        {
            "coverage": F.coalesce(F.try_divide("class_pixels", "frame_pixels"), F.lit(0.0)),
            "count_reportable": ~F.col("target").isin(*NEED_RADAR) | _radar_parts(parted),
        }
    )
    numbers = ["regions", "selected_pixels", "selected_area_m2", "class_pixels", "coverage", *TESTS, "beyond_limit"]
    asked = rows.where("error IS NULL").select("request_id", *numbers, "count_reportable", _answer().alias("answer"))
    return admitted.select("request_id", "error").join(asked, "request_id", "left")


def _radar_parts(parted: DataFrame | None) -> Column:
    return F.lit(False) if parted is None else F.coalesce("radar_parts", F.lit(False))


def _answer() -> Column:
    name = F.replace("target", F.lit("_"), F.lit(" "))
    where = F.coalesce(filled("ground.where", place=F.col("sector_phrase")), F.lit(""))
    pixels = F.col("selected_pixels").cast("string")
    extent = F.coalesce(filled("ground.area", area=square_km(F.col("selected_area_m2")), pixels=pixels), filled("ground.pixels", pixels=pixels))
    said = {"class": name, "where": where, "extent": extent, "n": F.col("regions").cast("string")}
    out = F.when(F.col("class_pixels") == 0, filled("ground.absent", **said)).when(F.col("regions") == 0, filled("ground.unmatched", **said))
    counted = F.when(F.col("regions") == 1, filled("ground.one", **said)).otherwise(filled("ground.many", **said))
    return out.when(F.col("count_reportable"), counted).otherwise(filled("ground.uncounted", **said))


def selection(found: DataFrame, labels: DataFrame) -> DataFrame:
    """request_id, scene_id, r, c: the pixels of the regions that each request keeps."""
    kept = found.where("left_out IS NULL").select("request_id", "scene_id", "class", "label")
    return kept.join(labels, ["scene_id", "class", "label"]).select("request_id", "scene_id", "r", "c")
