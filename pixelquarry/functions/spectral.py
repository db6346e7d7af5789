"""Per-pixel spectral arithmetic as column expressions. Null is an invalid value throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Band sums smaller than this have no normalised difference.
SMALLEST_SUM = 1e-6
#: Linear power is floored here before decibels.
POWER_FLOOR = 1e-10

#: index -> the bands it needs (fixed values).
INDEX_BANDS = {
    "ndvi": ("nir", "red"),
    "ndwi": ("green", "nir"),
    "mndwi": ("green", "swir1"),
    "ndbi": ("swir1", "nir"),
    "bsi": ("swir1", "red", "nir", "blue"),
    "exg": ("red", "green", "blue"),
    "brightness": ("red", "green", "blue"),
}
#: Published cuts, used where a histogram has no valley (fixed values).
REFERENCE_CUTS = {"mndwi": 0.0, "ndwi": 0.0, "ndvi": 0.30, "ndbi": 0.0, "exg": 0.05, "brightness": 0.35, "edges": 0.20}


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null: least and greatest alone would pass it over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def normalised_difference(a: Column, b: Column) -> Column:
    total = a + b
    return F.when(F.abs(total) >= SMALLEST_SUM, clip(F.try_divide(a - b, total), -1.0, 1.0))


def ndvi() -> Column:
    return normalised_difference(F.col("nir"), F.col("red"))


def ndwi() -> Column:
    return normalised_difference(F.col("green"), F.col("nir"))


def mndwi() -> Column:
    return normalised_difference(F.col("green"), F.col("swir1"))


def ndbi() -> Column:
    return normalised_difference(F.col("swir1"), F.col("nir"))


def bsi() -> Column:
    bright, dark = F.col("swir1") + F.col("red"), F.col("nir") + F.col("blue")
    return clip(F.try_divide(bright - dark, bright + dark), -1.0, 1.0)


def exg() -> Column:
    total = F.col("red") + F.col("green") + F.col("blue")
    share = [F.try_divide(F.col(c), total) for c in ("green", "red", "blue")]
    return clip(2 * share[0] - share[1] - share[2], -1.0, 1.0)


def band_mean(bands: list[Column]) -> Column:
    """Mean of the bands that are valid; null if none is."""
    count = sum((F.when(b.isNotNull(), 1).otherwise(0) for b in bands), F.lit(0))
    total = sum((F.coalesce(b, F.lit(0.0)) for b in bands), F.lit(0.0))
    return F.when(count > 0, total / count)


def to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def to_db(power: Column) -> Column:
    return F.when(power.isNotNull(), 10 * F.log10(F.greatest(power, F.lit(POWER_FLOOR))))


def score_map(index: Column) -> Column:
    """An index mapped from [-1, 1] to [0, 1]."""
    return clip((index + 1) / 2, 0.0, 1.0)


INDEX_EXPRESSIONS = {"ndvi": ndvi, "ndwi": ndwi, "mndwi": mndwi, "ndbi": ndbi, "bsi": bsi, "exg": exg}


def available_indices(bands: set[str]) -> list[str]:
    return [name for name, needed in INDEX_BANDS.items() if set(needed) <= bands]


#: property -> the indices that measure it, the first that both dates have is compared (fixed values).
FEATURE_GROUPS = (("ndvi",), ("mndwi", "ndwi"), ("ndbi",))


def shared_features(a: Column, b: Column) -> Column:
    """Of two arrays of available indices, the one of each property that both have."""
    both = F.array_intersect(a, b)
    first = [F.coalesce(*[F.when(F.array_contains(both, n), n) for n in group]) for group in FEATURE_GROUPS]
    return F.array_compact(F.array(*first))
