"""Land cover of optical scenes, and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions import spectral
from pixelquarry.functions.spectral import REFERENCE_CUTS as REFERENCE
from pixelquarry.operators.neighbourhood import clean_masks
from pixelquarry.operators.staging import staged
from pixelquarry.operators.thresholds import Cut, adaptive_thresholds, separability, stretch

#: class -> code (fixed values).
CLASSES = {"unclassified": 0, "water": 1, "vegetation": 2, "built_up": 3, "bare_soil": 4}


def code_name(code: Column, names: dict[str, int] = CLASSES) -> Column:
    out = F.lit(next(n for n, c in names.items() if c == 0))
    for name, value in names.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def valid(bands: list[str]) -> Column:
    """A pixel is valid if every band is."""
    out = F.lit(True)
    for b in bands:
        out = out & F.col(b).isNotNull()
    return out


def with_indices(px: DataFrame, names: list[str]) -> DataFrame:
    return px.withColumns({n: spectral.INDEX_EXPRESSIONS[n]() for n in names})


#: The least built-up or water patch, in square metres, and in pixels where these have no area.
MIN_PATCH_M2, MIN_PATCH_PIXELS = 2500.0, 25


def with_cuts(px: DataFrame, cuts: list[Cut], by: list[str]) -> DataFrame:
    """``px`` with the thresholds of its group; their table, a row a group, is written first."""
    return px.join(staged(adaptive_thresholds(px, cuts, by)), by, "left")


def min_patch(px: DataFrame, by: list[str], pixel_area: float | None) -> int:
    """Pixels of the least patch, where all pixels have one area or none."""
    return MIN_PATCH_PIXELS if pixel_area is None else max(1, round(MIN_PATCH_M2 / pixel_area))


def classify(
    px: DataFrame, bands: list[str], by: list[str] = ["scene_id"], edges: str | None = None, pixel_area: float | None = 100.0
) -> DataFrame:
    """``px`` with class_code, evidence and valid, by the spectral cascade.

    Water is where the water index is over its cut; of the rest vegetation is where ndvi is; of the
    rest built-up is where ndbi is over a cut taken from that remainder, and, if ``edges`` names an
    edge-density column, that is as well; built-up patches are opened, closed and freed of small ones.
    What is left of the valid pixels is bare soil. Evidence is the deciding index. Null bands give
    class 0, but for pixels that closing gives to a built-up patch; water and plants give way to it too.
    """
    water = "mndwi" if "swir1" in bands else "ndwi"
    px = staged(with_indices(px, [water, "ndvi", *["ndbi"] * ("swir1" in bands)]).withColumn("valid", valid(bands)))
    px = with_cuts(px, [Cut("water_cut", F.col(water), REFERENCE[water]), Cut("vegetation_cut", F.col("ndvi"), REFERENCE["ndvi"])], by)
    is_water = F.coalesce(F.col(water) > F.col("water_cut"), F.lit(False))
    is_plant = F.coalesce(F.col("ndvi") > F.col("vegetation_cut"), F.lit(False)) & ~is_water
    is_built, built_evidence = F.lit(False), F.lit(0.0)
    if "swir1" in bands:
        rest = F.col("valid") & ~is_water & ~is_plant & F.col("ndbi").isNotNull()
        cuts = [Cut("built_cut", F.when(rest, F.col("ndbi")), REFERENCE["ndbi"], region=True)]
        cuts += [Cut("edge_cut", F.when(rest, F.col(edges)), REFERENCE["edges"], region=True)] if edges else []
        px = with_cuts(px, cuts, by)
        raw = rest & (F.col("ndbi") > F.col("built_cut"))
        built_evidence = spectral.score_map(F.col("ndbi"))
        if edges:
            raw = raw & (F.col(edges) > F.col("edge_cut"))
            built_evidence = 0.5 * built_evidence + 0.5 * F.col(edges)
        px = clean_masks(px.withColumn("built", F.coalesce(raw, F.lit(False))), ["built"], 1, 2, min_patch(px, by, pixel_area), by)
        is_built = F.col("built")
    code = F.when(is_built, 3).when(is_water, 1).when(is_plant, 2).when(F.col("valid"), 4).otherwise(0)
    evidence = F.when(is_built, built_evidence).when(is_water, spectral.clip(F.col(water), 0.0, 1.0))
    evidence = evidence.when(is_plant, spectral.clip(F.col("ndvi"), 0.0, 1.0)).otherwise(0.0)
    return px.withColumns({"class_code": code.cast("int"), "evidence": evidence})


def classify_rgb(px: DataFrame, by: list[str] = ["scene_id"], pixel_area: float | None = 100.0) -> DataFrame:
    """``px`` with class_code and evidence from red, green and blue alone; built-up is never claimed.

    Water is dark, and bluer than red; its patches are opened, closed and freed of small ones. Evidence is
    how dark water and how green a plant is; the rest has none.
    """
    px = with_indices(px.withColumn("valid", valid(["red", "green", "blue"])), ["exg"])
    for band in ("red", "green", "blue"):
        px = stretch(px, band, by, 0.01, 0.99, band + "_1")
    bright = (F.coalesce("red_1", F.lit(0.0)) + F.coalesce("green_1", F.lit(0.0)) + F.coalesce("blue_1", F.lit(0.0))) / 3
    px = staged(px.withColumn("brightness", F.when(F.col("valid"), bright)).drop("red_1", "green_1", "blue_1"))
    px = with_cuts(px, [Cut("dark_cut", F.col("brightness"), REFERENCE["brightness"])], by)
    raw = F.coalesce(F.col("valid") & (F.col("blue") > F.col("red")) & (F.col("brightness") < F.col("dark_cut")), F.lit(False))
    px = clean_masks(px.withColumn("water", raw), ["water"], 1, 2, min_patch(px, by, pixel_area), by)
    px = staged(px)
    is_water = F.col("water")
    px = with_cuts(px, [Cut("green_cut", F.when(F.col("valid") & ~is_water, F.col("exg")), REFERENCE["exg"], region=True)], by)
    is_plant = F.coalesce(F.col("exg") > F.col("green_cut"), F.lit(False)) & F.col("valid") & ~is_water
    code = F.when(is_water, 1).when(is_plant, 2).when(F.col("valid"), 4).otherwise(0)
    evidence = F.when(is_water, spectral.clip(1 - F.col("brightness"), 0.0, 1.0)).when(is_plant, spectral.clip(F.col("exg"), 0.0, 1.0))
    return px.withColumns({"class_code": code.cast("int"), "evidence": F.coalesce(evidence, F.lit(0.0))})


#: class -> its indices, the first that a scene has; bare soil, the remainder, has none (fixed values).
CLASS_INDICES = {"water": ("mndwi", "ndwi"), "vegetation": ("ndvi",), "built_up": ("ndbi",)}


def class_score(name: str, available: list[str]) -> Column:
    """How strongly a pixel speaks for a class, 0 to 1: null where no index does."""
    found = [F.col(i) for i in CLASS_INDICES.get(name, ()) if i in available]
    return spectral.score_map(F.coalesce(*found)) if found else F.lit(None).cast("double")


def mean_separability(classified: DataFrame, available: list[str], by: list[str] = ["scene_id"]) -> DataFrame:
    """by, separability: the mean over water, vegetation and built-up where they occur, else 0.

    Water is judged on ndwi, and on mndwi only where ndwi is missing.
    """
    water = next(i for i in ("ndwi", "mndwi") if i in available)
    rows, codes = None, {water: 1, "ndvi": 2, "ndbi": 3}
    for index, code in codes.items():
        if index in available:
            own = separability(classified, index, F.col("class_code") == code, by)
            occurs = classified.groupBy(*by).agg(F.count_if(F.col("class_code") == code).alias("n")).where("n > 0").select(*by)
            rows = own.join(occurs, by) if rows is None else rows.unionByName(own.join(occurs, by))
    found = rows.groupBy(*by).agg(F.avg("separability").alias("separability"))
    return classified.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("separability", F.lit(0.0)).alias("separability"))


def class_stats(classified: DataFrame, pixel_area: float | None, by: list[str] = ["scene_id"]) -> DataFrame:
    """by, class, pixel_count, fraction (of valid pixels), area_m2, mean_evidence, largest first."""
    totals = classified.groupBy(*by).agg(F.count_if("valid").alias("total"))
    counted = classified.where("class_code > 0").groupBy(*by, "class_code").agg(
        F.count("*").alias("pixel_count"), F.avg("evidence").alias("mean_evidence")
    )
    return counted.join(totals, by).select(
        *by,
        code_name(F.col("class_code")).alias("class"),
        "pixel_count",
        F.try_divide("pixel_count", "total").alias("fraction"),
        (F.col("pixel_count") * F.lit(pixel_area).cast("double")).alias("area_m2"),
        "mean_evidence",
    )


def dominant(stats: DataFrame, by: list[str], name: str) -> DataFrame:
    """The group with the most pixels; ties go to the first name."""
    key = F.struct(-F.col("pixel_count"), F.col(name))
    return stats.groupBy(*by).agg(F.min_by(F.col(name), key).alias(name), F.max("pixel_count").alias("pixel_count"))


def index_summary(px: DataFrame, names: list[str], by: list[str] = ["scene_id"]) -> DataFrame:
    """by, index, valid_fraction, mean, min, max of each index, rounded to four places."""
    wide = px.groupBy(*by).agg(
        *[
            F.struct(
                F.round(F.count(n) / F.count("*"), 4).alias("valid_fraction"),
                F.round(F.avg(n), 4).alias("mean"),
                F.round(F.min(n), 4).alias("min"),
                F.round(F.max(n), 4).alias("max"),
            ).alias(n)
            for n in names
        ]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("index"), F.col(n).alias("s")) for n in names])
    return wide.select(*by, F.explode(rows).alias("row")).select(*by, "row.index", "row.s.*")
