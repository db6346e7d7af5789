"""Change between two dates of one grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.spectral import band_mean
from pixelquarry.operators import thresholds
from pixelquarry.operators.landcover import CLASSES, code_name, min_patch
from pixelquarry.operators.neighbourhood import clean_masks
from pixelquarry.operators.staging import staged

BY = ["scene_id"]
#: The water index that comes first is used; one index a property.
FEATURES = ("ndvi", "mndwi", "ndbi")
MIN_AGREEMENT = 0.60


def change_type(before: Column, after: Column) -> Column:
    """The name of a transition, by its destination; same class or an unknown one have their own."""
    lost = F.when(before == 1, "water_loss").when(before == 2, "vegetation_loss").otherwise("urban_loss")
    out = F.when(before == after, "spectral_only").when((before == 0) | (after == 0), "other")
    return out.when(after == 1, "water_gain").when(after == 2, "vegetation_gain").when(after == 3, "urban_expansion").otherwise(lost)


def co_grid(pair: DataFrame, columns: list[str]) -> DataFrame:
    """Both dates (column ``date``: before, after) in one row by place; columns end in _b and _a, and
    valid holds where both are."""
    side = lambda x, d: F.max(F.when(F.col("date") == d, F.col(x))).alias(f"{x}_{d[0]}")
    rows = pair.groupBy(*BY, "r", "c").agg(*[side(x, d) for x in columns for d in ("before", "after")])
    return rows.withColumn("valid", F.coalesce(F.col("valid_b") & F.col("valid_a"), F.lit(False)))


def detect(pair: DataFrame, features: tuple[str, ...] = FEATURES, pixel_area: float | None = 100.0) -> DataFrame:
    """``pair`` with magnitude, spectral, by_class and changed.

    The magnitude is the root mean square difference of the features; the spectral detector takes
    Otsu's cut where it is justified, else the robust outlier bound; the class detector takes
    pixels whose classes are known and differ. Each detector is opened, closed and freed of small
    patches; changed is either.
    """
    n = len(features)
    square = sum((F.pow(F.col(f + "_a") - F.col(f + "_b"), F.lit(2.0)) for f in features), F.lit(0.0)) / n
    rows = staged(pair.withColumn("magnitude", F.when(F.col("valid"), F.sqrt(square))))
    cut = thresholds.adaptive_threshold(rows, "magnitude", BY, float("nan")).join(thresholds.outlier_bound(rows, "magnitude", BY), BY, "left")
    cut = staged(cut.select(*BY, F.when(F.col("method") == "otsu", F.col("threshold")).otherwise(F.col("bound")).alias("cut"), "method", "quality"))
    known = (F.col("class_code_b") > 0) & (F.col("class_code_a") > 0)
    rows = rows.join(cut, BY, "left").withColumns(
        {
            "spectral": F.coalesce(F.col("valid") & (F.col("magnitude") > F.col("cut")), F.lit(False)),
            "by_class": F.coalesce(F.col("valid") & known & (F.col("class_code_b") != F.col("class_code_a")), F.lit(False)),
        }
    )
    rows = clean_masks(rows, ["spectral", "by_class"], 1, 2, min_patch(rows, BY, pixel_area), BY)
    rows = rows.withColumns({m: F.col(m) & F.col("valid") for m in ("spectral", "by_class")})
    return rows.withColumn("changed", F.col("spectral") | F.col("by_class"))


def transitions(detected: DataFrame, pixel_area: float | None) -> DataFrame:
    """before, after, change_type, pixel_count, fraction_of_change, area_m2, mean_magnitude and
    spectral_agreement of the changed pixels."""
    changed = detected.where("changed")
    totals = changed.groupBy(*BY).agg(F.count("*").alias("total"))
    counted = changed.groupBy(*BY, "class_code_b", "class_code_a").agg(
        F.count("*").alias("pixel_count"), F.avg("magnitude").alias("mean_magnitude"), F.avg(F.col("spectral").cast("int")).alias("spectral_agreement")
    )
    b, a = F.col("class_code_b"), F.col("class_code_a")
    return counted.join(totals, BY).select(
        *BY, code_name(b).alias("before"), code_name(a).alias("after"), change_type(b, a).alias("change_type"), "pixel_count",
        (F.col("pixel_count") / F.col("total")).alias("fraction_of_change"),
        (F.col("pixel_count") * F.lit(pixel_area).cast("double")).alias("area_m2"), "mean_magnitude", "spectral_agreement",
    )


def reportable(trans: DataFrame, gate_passed: Column) -> DataFrame:
    """``trans`` with reportable and the reason that it isn't: the pair's registration, or too little
    agreement of the spectral measurement."""
    weak = F.col("spectral_agreement") < MIN_AGREEMENT
    reason = F.when(~gate_passed, "registration").when(weak, "agreement")
    return trans.withColumns({"reportable": reason.isNull() & (F.col("change_type") != "spectral_only"), "withheld": reason})


def class_deltas(pair: DataFrame, pixel_area: float | None) -> DataFrame:
    """class, before, after, delta, relative (null if before is 0) over jointly valid pixels."""
    ok = pair.where("valid")
    sides = [ok.groupBy(*BY, F.col(f"class_code_{e}").alias("code")).agg(F.count("*").alias(n)) for e, n in (("b", "before"), ("a", "after"))]
    rows = sides[0].join(sides[1], [*BY, "code"], "full").where("code > 0").fillna(0, ["before", "after"])
    delta = F.col("after") - F.col("before")
    return rows.select(*BY, code_name(F.col("code"), CLASSES).alias("class"), "before", "after", delta.alias("delta"), F.try_divide(delta, "before").alias("relative"),
                       (delta * F.lit(pixel_area).cast("double")).alias("delta_m2"))


def index_deltas(detected: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """index, mean_before, mean_after, mean_delta and increasing share inside change, direction."""
    aggs = []
    for n in names:
        diff = F.when(F.col("changed"), F.col(n + "_a") - F.col(n + "_b"))
        aggs.append(
            F.struct(
                F.avg(F.when(F.col("valid"), F.col(n + "_b"))).alias("mean_before"), F.avg(F.when(F.col("valid"), F.col(n + "_a"))).alias("mean_after"),
                F.avg(diff).alias("mean_delta"), F.avg((diff > 0).cast("int")).alias("increasing"),
            ).alias(n)
        )
    wide = detected.groupBy(*BY).agg(*aggs)
    rows = wide.select(*BY, F.explode(F.array(*[F.struct(F.lit(n).alias("index"), F.col(n).alias("s")) for n in names])).alias("x")).select(*BY, "x.index", "x.s.*")
    return rows.withColumn("direction", F.when(F.col("increasing") >= 0.6, "increase").when(F.col("increasing") <= 0.4, "decrease").otherwise("mixed"))


def evidence_split(detected: DataFrame) -> DataFrame:
    """corroborated, spectral_only, class_only and the corroborated share of change."""
    both = F.count_if(F.expr("spectral AND by_class"))
    return detected.groupBy(*BY).agg(
        both.alias("corroborated"), F.count_if(F.expr("spectral AND NOT by_class")).alias("spectral_only"), F.count_if(F.expr("by_class AND NOT spectral")).alias("class_only"),
        F.try_divide(both, F.count_if("changed")).alias("corroborated_fraction"),
    )


def dominant_transition(judged: DataFrame) -> DataFrame:
    """scene_id, before, after, change_type, pixel_count, reportable, withheld of the largest real
    transition, which changes the class; scenes without one have no row."""
    real = judged.where("change_type != 'spectral_only'")
    names = ("before", "after", "change_type", "pixel_count", "reportable", "withheld")
    order = F.struct(-F.col("pixel_count"), "before", "after")
    return real.groupBy(*BY).agg(F.min_by(F.struct(*names), order).alias("d")).select(*BY, "d.*")


def _by_place(pair: DataFrame, bands: list[str]) -> DataFrame:
    """Both dates' bands in one row by place, ending in _b and _a."""
    side = lambda x, d: F.max(F.when(F.col("date") == d, F.col(x))).alias(f"{x}_{d[0]}")
    return pair.groupBy(*BY, "r", "c").agg(*[side(x, d) for x in bands for d in ("before", "after")])


def match_radiometry(pair: DataFrame, bands: list[str]) -> DataFrame:
    """scene_id, r, c and the bands of the later date with the mean and deviation of the earlier one,
    over pixels that are valid in both (100 at least); a constant later band stays as it is, and a
    constant earlier one gives its mean alone."""
    rows = _by_place(pair, bands)
    both = lambda x, y: F.when(F.col(y).isNotNull(), F.col(x))
    aggs = []
    for x in bands:
        b, a = both(f"{x}_b", f"{x}_a"), both(f"{x}_a", f"{x}_b")
        aggs.append(F.struct(F.count(b).alias("n"), F.avg(b).alias("mb"), F.avg(a).alias("ma"), F.stddev_pop(b).alias("sb"), F.stddev_pop(a).alias("sa")).alias(f"_{x}"))
    rows = rows.join(rows.groupBy(*BY).agg(*aggs), BY)

    def matched(x: str) -> Column:
        m, y = F.col(f"_{x}"), F.col(f"{x}_a")
        scaled = F.when(m["sb"] > 1e-12, (y - m["ma"]) * m["sb"] / m["sa"] + m["mb"]).otherwise(y - m["ma"] + m["mb"])
        return F.when((m["n"] >= 100) & (m["sa"] > 1e-12), scaled).otherwise(y)

    return rows.select(*BY, "r", "c", *[matched(x).alias(x) for x in bands])


def joint_band_stack(pair: DataFrame, bands: list[str]) -> DataFrame:
    """scene_id, r, c, each band of both dates (_b, _a) and magnitude, for dates that share no index.

    A band is scaled by the first and last percentile of both dates together; one without a range is
    left null and out of the magnitude, the root mean square of the bands' differences.
    """
    rows = _by_place(pair, bands)
    ends = pair.groupBy(*BY).agg(*[F.percentile(x, F.array(F.lit(0.01), F.lit(0.99))).alias(f"_{x}") for x in bands])
    rows = rows.join(ends, BY)

    def scaled(x: str, d: str) -> Column:
        lo, hi, v = F.col(f"_{x}")[0], F.col(f"_{x}")[1], F.col(f"{x}_{d}")
        return F.when(v.isNotNull() & (hi - lo >= 1e-12), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))))

    rows = rows.select(*BY, "r", "c", *[scaled(x, d).alias(f"{x}_{d}") for x in bands for d in "ba"])
    squares = [F.pow(F.col(f"{x}_a") - F.col(f"{x}_b"), F.lit(2.0)) for x in bands]
    return rows.withColumn("magnitude", F.sqrt(band_mean(squares)))
