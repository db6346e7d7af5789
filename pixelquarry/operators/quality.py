"""Measured quality of a scene, and what to warn of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators.landcover import valid
from pixelquarry.operators.neighbourhood import laplacian
from pixelquarry.operators.staging import staged
from pixelquarry.operators.thresholds import fill_invalid, stretch

#: Of the range, how near to an end a saturated value is.
PINNED = 0.005


def sharpness(px: DataFrame, band: str, by: list[str] = ["scene_id"]) -> DataFrame:
    """by, sharpness: twenty times the variance of the stretched band's Laplacian, 1 at most."""
    rows = stretch(fill_invalid(px, band, by), band, by, 0.01, 0.99, "_s")
    return laplacian(rows, "_s", "_lap").groupBy(*by).agg(F.least(F.lit(1.0), F.var_pop("_lap") * 20).alias("sharpness"))


def input_quality(px: DataFrame, bands: list[str], by: list[str] = ["scene_id"]) -> DataFrame:
    """by, nodata_fraction, dynamic_range, saturation_fraction, sharpness, score and warnings.

    Range and saturation are means over bands, of valid values; a band without any has no range and
    counts as saturated. Sharpness is the first band's. ``warnings`` is an array of codes.
    """
    px = staged(px)
    tall = px.select(*by, F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("x")) for b in bands])).alias("v")).select(*by, "v.*")
    ends = tall.groupBy(*by, "band").agg(F.percentile("x", F.array(F.lit(0.02), F.lit(0.98))).alias("p"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = ends.withColumn("span", F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)))
    x, near = F.col("x"), F.col("span") * PINNED
    pinned = (x <= F.col("lo") + near) | (x >= F.col("lo") + F.col("span") - near)
    by_band = tall.join(ends, [*by, "band"]).groupBy(*by, "band").agg(
        F.coalesce(F.max((F.col("p")[1] - F.col("p")[0]) / F.col("span")), F.lit(0.0)).alias("range"),
        F.coalesce(F.avg(F.when(x.isNotNull(), pinned.cast("int"))), F.lit(1.0)).alias("saturated"),
    )
    rows = by_band.groupBy(*by).agg(F.avg("range").alias("dynamic_range"), F.avg("saturated").alias("saturation_fraction"))
    rows = rows.join(px.groupBy(*by).agg((1 - F.avg(valid(bands).cast("int"))).alias("nodata_fraction")), by)
    rows = rows.join(sharpness(px, bands[0], by), by)
    part = lambda c, full: F.least(F.col(c) / full, F.lit(1.0))
    score = 0.35 * (1 - F.col("nodata_fraction")) + 0.30 * part("dynamic_range", 0.5) + 0.20 * (1 - part("saturation_fraction", 0.4)) + 0.15 * part("sharpness", 0.1)
    said = F.array(
        F.when(F.col("nodata_fraction") > 0.5, "mostly_nodata").when(F.col("nodata_fraction") > 0.15, "some_nodata"),
        F.when(F.col("dynamic_range") < 0.15, "low_contrast"),
        F.when(F.col("saturation_fraction") > 0.25, "saturated"),
        F.when(F.col("sharpness") < 0.02, "blurred"),
    )
    numbers = ["nodata_fraction", "dynamic_range", "saturation_fraction", "sharpness"]
    return rows.select(*by, *numbers, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.array_compact(said).alias("warnings"))
