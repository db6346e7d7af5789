"""Radar backscatter: speckle, scattering regimes, and fusion with optical land cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.functions.spectral import to_db, to_linear
from pixelquarry.operators import thresholds
from pixelquarry.operators.landcover import code_name
from pixelquarry.operators.neighbourhood import box_mean
from pixelquarry.operators.staging import staged

#: regime -> code; regime code -> land-cover codes that fit it (fixed values).
REGIMES = {"unclassified": 0, "smooth": 1, "diffuse": 2, "double_bounce": 3}
CONSISTENT = {1: (1, 4), 2: (2, 4), 3: (3,)}
EVIDENCE = {"neither": 0, "both": 1, "conflict": 2, "optical_only": 3, "sar_only": 4}
WINDOW, LOOKS = 7, (1.0, 64.0)
REFERENCE_DB = (-16.0, -7.0)
BY = ["scene_id"]


def looks_like_db(px: DataFrame, band: str) -> DataFrame:
    """scene_id, is_db: some value below 0, none below -60, and a median of 0 at most."""
    agg = px.groupBy(*BY).agg(F.min(band).alias("lo"), F.median(band).alias("mid"))
    return agg.select(*BY, F.coalesce((F.col("lo") < 0) & (F.col("lo") >= -60) & (F.col("mid") <= 0), F.lit(False)).alias("is_db"))


def local_statistics(px: DataFrame, power: str, window: int = WINDOW) -> DataFrame:
    """scene_id, r, c, power, share (of valid pixels), mean and var over the window."""
    ok = F.col(power) > 0
    rows = px.select(*BY, "r", "c", F.when(ok, F.col(power)).alias("x"))
    sums = box_mean(rows.withColumns({"ok": F.col("x").isNotNull().cast("double"), "xx": F.col("x") * F.col("x")}), ["x", "xx", "ok"], window)
    sums = sums.withColumnsRenamed({"x": "sx"})
    mean = F.when(F.col("ok") > 1e-9, F.col("sx") / F.col("ok")).otherwise(0.0)
    square = F.when(F.col("ok") > 1e-9, F.col("xx") / F.col("ok")).otherwise(0.0)
    rows = rows.join(sums, [*BY, "r", "c"]).withColumns({"mean": mean, "square": square})
    var = F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return rows.select(*BY, "r", "c", F.col("x").alias("power"), F.col("ok").alias("share"), "mean", var.alias("var"))


def looks(stats: DataFrame, window: int = WINDOW) -> DataFrame:
    """scene_id, cv (median over full windows) and enl, the looks that it stands for (1 to 64)."""
    full = F.when((F.col("share") > 0.999) & (F.col("mean") > 1e-12) & F.col("power").isNotNull(), F.sqrt("var") / F.col("mean"))
    agg = stats.groupBy(*BY).agg(F.median(full).alias("cv"), F.count("power").alias("valid"))
    measured = F.greatest(F.lit(LOOKS[0]), F.least(F.lit(LOOKS[1]), F.try_divide(F.lit(1.0), F.col("cv") * F.col("cv"))))
    enl = F.when((F.col("valid") < window * window * 4) | F.col("cv").isNull(), LOOKS[0]).when(F.col("cv") <= 1e-6, LOOKS[1])
    return agg.select(*BY, F.coalesce("cv", F.lit(0.0)).alias("cv"), enl.otherwise(measured).alias("enl"))


def lee(stats: DataFrame, enl: DataFrame) -> DataFrame:
    """scene_id, r, c, filtered: the local mean, moved towards the pixel where it varies more than
    speckle does; an invalid pixel stays invalid."""
    rows = stats.join(enl.select(*BY, (1 / F.col("enl")).alias("cu")), BY)
    signal = F.greatest(F.col("var") - F.col("cu") * F.col("mean") * F.col("mean"), F.lit(0.0)) / (1 + F.col("cu"))
    gain = F.when(F.col("var") > 1e-20, signal / F.col("var")).otherwise(0.0)
    out = F.col("mean") + gain * (F.col("power") - F.col("mean"))
    return rows.select(*BY, "r", "c", F.when(F.col("power").isNotNull(), F.when(out > 0, out).otherwise(F.col("mean"))).alias("filtered"))


def despeckle(px: DataFrame, power: str, window: int = WINDOW) -> DataFrame:
    """scene_id, r, c, db: filtered backscatter in decibels."""
    stats = staged(local_statistics(px, power, window))
    return lee(stats, looks(stats, window)).select(*BY, "r", "c", to_db(F.col("filtered")).alias("db"))


def regime_thresholds(px: DataFrame, db: str) -> DataFrame:
    """scene_id, low, high, smooth_db, bright_db, smooth_prominence, bright_prominence.

    Two cuts of three classes; the lower is kept if a valley of prominence 0.25 goes with it, the
    upper is cut again among what lies above it and kept on the same terms.
    """
    values = staged(px.where(F.col(db).isNotNull()).select(*BY, F.col(db).alias("x")))
    cuts = staged(thresholds.multilevel_otsu(values, "x", BY, 256))
    joined = values.join(cuts, BY)
    smooth = thresholds.mode_prominence(joined.where("x <= high"), "x", cuts, BY, "low").withColumnRenamed("prominence", "smooth_prominence")
    tail = staged(joined.where("x >= high").select(*BY, "x"))
    able = tail.groupBy(*BY).agg(F.count("*").alias("n")).where("n >= 64")
    upper = staged(thresholds.otsu(tail, "x", BY).join(able, BY).select(*BY, F.col("threshold").alias("cut")))
    bright = thresholds.mode_prominence(joined.where("x >= low"), "x", upper, BY, "cut").withColumnRenamed("prominence", "bright_prominence")
    rows = cuts.join(smooth, BY, "left").join(upper, BY, "left").join(bright, BY, "left")
    keep = lambda p, x: F.when(F.col(p) >= thresholds.MIN_PROMINENCE, F.col(x))
    return rows.select(
        *BY, "low", "high",
        keep("smooth_prominence", "low").alias("smooth_db"), keep("bright_prominence", "cut").alias("bright_db"),
        F.coalesce("smooth_prominence", F.lit(0.0)).alias("smooth_prominence"),
        F.when(F.col("cut").isNotNull(), F.col("bright_prominence")).otherwise(0.0).alias("bright_prominence"),
    )


def coded(px: DataFrame, db: str, smooth: Column, bright: Column) -> DataFrame:
    """``px`` with regime_code; what lies between the cuts is one diffuse class."""
    x = F.col(db)
    code = F.when(x.isNull(), 0).when(x > bright, 3).when(x < smooth, 1).otherwise(2)
    return px.withColumn("regime_code", code.cast("int"))


def regime_map(px: DataFrame, db: str, cuts: DataFrame) -> DataFrame:
    """``px`` with the regime_code that its scene's ``cuts`` give."""
    rows = px.join(cuts.select(*BY, "smooth_db", "bright_db"), BY, "left")
    return coded(rows, db, F.col("smooth_db"), F.col("bright_db"))


def regime_stats(regimes: DataFrame, db: str, pixel_area: float | None) -> DataFrame:
    """scene_id, regime, pixel_count, fraction, area_m2, mean_db of each regime that occurs."""
    totals = regimes.groupBy(*BY).agg(F.count_if(F.expr("regime_code > 0")).alias("total"))
    counted = regimes.where("regime_code > 0").groupBy(*BY, "regime_code").agg(F.count("*").alias("pixel_count"), F.avg(db).alias("mean_db"))
    return counted.join(totals, BY).select(
        *BY, code_name(F.col("regime_code"), REGIMES).alias("regime"), "pixel_count",
        (F.col("pixel_count") / F.col("total")).alias("fraction"), (F.col("pixel_count") * F.lit(pixel_area).cast("double")).alias("area_m2"), "mean_db",
    )


def fuse(optical: DataFrame, radar: DataFrame, sar_decides_built_up: Column, carry: list[str] = []) -> DataFrame:
    """scene_id, r, c, class_code, regime_code, evidence_code, fused_code, arbiter.

    Consistent readings keep the optical class. Of those that disagree, a double bounce makes
    built-up land; an optical built-up without one becomes bare soil if radar did separate bright
    returns, else it stands unresolved; any other optical class stands. Radar alone names a class
    only if one land cover fits its regime. ``sar_decides_built_up`` is an expression over scene_id and
    the columns of ``radar`` that ``carry`` names.
    """
    rows = optical.select(*BY, "r", "c", "class_code").join(radar.select(*BY, "r", "c", "regime_code", *carry), [*BY, "r", "c"])
    cls, regime = F.col("class_code"), F.col("regime_code")
    fits = F.lit(False)
    for code, classes in CONSISTENT.items():
        fits = fits | ((regime == code) & cls.isin(*classes))
    known, heard = cls > 0, regime > 0
    evidence = F.when(known & heard & fits, 1).when(known & heard, 2).when(known, 3).when(heard, 4).otherwise(0)
    rows = rows.withColumns({"evidence_code": evidence.cast("int"), "_decides": sar_decides_built_up})
    conflict = F.col("evidence_code") == 2
    only = {code: classes[0] for code, classes in CONSISTENT.items() if len(classes) == 1}
    alone = F.lit(0)
    for code, name in only.items():
        alone = F.when(regime == code, name).otherwise(alone)
    arbiter = F.when(~conflict, F.lit(None)).when(regime == 3, "sar").when((cls == 3) & F.col("_decides"), "sar").when(cls == 3, "none").otherwise("optical")
    fused = F.when(conflict & (regime == 3), 3).when(conflict & (cls == 3) & F.col("_decides"), 4).when(F.col("evidence_code") == 4, alone).otherwise(cls)
    return rows.withColumns({"fused_code": fused.cast("int"), "arbiter": arbiter}).drop("_decides", *carry)


def fused_stats(fused: DataFrame) -> DataFrame:
    """scene_id, class, pixel_count, fraction (of classified), corroborated_fraction, evidence."""
    classified = fused.where("fused_code > 0")
    whole = Window.partitionBy(*BY)
    counted = classified.groupBy(*BY, "fused_code").agg(
        F.count("*").alias("pixel_count"),
        *[F.count_if(F.col("evidence_code") == code).alias(name) for name, code in EVIDENCE.items() if code],
    )
    parts = F.create_map(*[x for name, code in EVIDENCE.items() if code for x in (F.lit(name), F.col(name))])
    return counted.select(
        *BY, code_name(F.col("fused_code")).alias("class"), "pixel_count",
        (F.col("pixel_count") / F.sum("pixel_count").over(whole)).alias("fraction"),
        (F.col("both") / F.col("pixel_count")).alias("corroborated_fraction"),
        F.map_filter(parts, lambda _, n: n > 0).alias("evidence"),
    )


def conflict_groups(fused: DataFrame, pixel_area: float | None) -> DataFrame:
    """scene_id, optical_class, sar_regime, pixel_count, fraction (of all), resolved_as, arbiter."""
    totals = fused.groupBy(*BY).agg(F.count("*").alias("total"))
    counted = fused.where("evidence_code = 2").groupBy(*BY, "class_code", "regime_code", "fused_code", "arbiter").agg(F.count("*").alias("pixel_count"))
    return counted.join(totals, BY).select(
        *BY, code_name(F.col("class_code")).alias("optical_class"), code_name(F.col("regime_code"), REGIMES).alias("sar_regime"),
        "pixel_count", (F.col("pixel_count") / F.col("total")).alias("fraction"),
        (F.col("pixel_count") * F.lit(pixel_area).cast("double")).alias("area_m2"), code_name(F.col("fused_code")).alias("resolved_as"), "arbiter",
    )


def agreement(fused: DataFrame) -> DataFrame:
    """scene_id, agreement: consistent pixels among those that both sensors established."""
    both = F.count_if(F.expr("evidence_code = 1"))
    return fused.groupBy(*BY).agg(F.try_divide(both, F.count_if(F.expr("evidence_code IN (1, 2)"))).alias("agreement"))


def as_power(px: DataFrame, band: str) -> DataFrame:
    """``px`` with power: the band in linear units, whether it holds decibels or not."""
    found = looks_like_db(px, band)
    return px.join(found, BY).withColumn("power", F.when(F.col("is_db"), to_linear(F.col(band))).otherwise(F.col(band))).drop("is_db")


def speckle_report(px: DataFrame, power: str, window: int = WINDOW) -> DataFrame:
    """scene_id, enl, cv_before, cv_after and reduction (their ratio) of the speckle filter."""
    stats = staged(local_statistics(px, power, window))
    before = staged(looks(stats, window))
    after = looks(local_statistics(lee(stats, before), "filtered", window), window)
    rows = before.withColumnRenamed("cv", "cv_before").join(after.select(*BY, F.col("cv").alias("cv_after")), BY)
    return rows.select(*BY, "enl", "cv_before", "cv_after", F.try_divide("cv_before", "cv_after").alias("reduction"))


#: Fewer valid pixels than this are no radar scene.
LEAST_VALID = 64
NOTHING = "No scattering regimes could be measured from this radar image."


def sentence(stats: DataFrame) -> DataFrame:
    """scene_id, answer: the largest regime of a scene and which regimes were separated."""
    row = F.struct((-F.col("pixel_count")).alias("o"), "regime", "fraction", "mean_db")
    rows = stats.groupBy(*BY).agg(F.sort_array(F.collect_list(row)).alias("l"))
    top, named = F.col("l")[0], lambda x: F.replace(x, F.lit("_"), F.lit("-"))
    lead = F.format_string("The radar backscatter is predominantly %s scattering (%d%% of valid pixels, mean %.1f dB). Regimes found: ", named(top["regime"]), F.round(top["fraction"] * 100).cast("long"), F.round(top["mean_db"], 1))
    return rows.select(*BY, F.concat(lead, F.array_join(F.transform("l", lambda x: named(x["regime"])), ", "), F.lit(".")).alias("answer"))
