"""Histograms and the cuts that they justify, for each group of a keyed table of values.

Every function takes ``by``, the grouping columns, and ``value``, a numeric column in which null is
invalid; the aggregates have one row a group, and a histogram as many rows as it has bins. The
values themselves are read once for the bounds and once for the bins, both with partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIMODAL_FROM = 5.0 / 9.0
MIN_QUALITY = 0.55
MIN_PROMINENCE = 0.25
MAD_TO_SIGMA, OUTLIER_SIGMAS = 1.4826, 3.0


def histogram(df: DataFrame, value: str, by: list[str], bins: int) -> DataFrame:
    """by, bin, n, lo, hi: equal-width bins over the group's range, the last one closed.

    All bins are there, empty ones too; a group whose values are all alike has none.
    """
    valid = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    bounds = valid.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("hi - lo >= 1e-9")
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counted = valid.join(bounds, by).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi")


def _centre(bins: int) -> Column:
    width = (F.col("hi") - F.col("lo")) / bins
    return F.col("lo") + (F.col("bin") + 0.5) * width


def _shares(hist: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Bin shares p, centres x, and running sums w of p and m of p * x; total mean mt."""
    group = Window.partitionBy(*by)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumns({"p": F.col("n") / F.sum("n").over(group), "x": _centre(bins)})
    rows = rows.withColumns({"w": F.sum("p").over(upto), "m": F.sum(F.col("p") * F.col("x")).over(upto)})
    return rows.withColumn("mt", F.max_by("m", "bin").over(group))


def otsu(df: DataFrame, value: str, by: list[str], bins: int = 256) -> DataFrame:
    """by, threshold, quality: the cut with the largest variance between classes.

    The middle of the unbroken run of bins around the largest that are within 1e-9 of it; quality is
    the share of all variance. Groups of fewer than 16 values or no range have no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("valid")).where("valid >= 16")
    rows = _shares(histogram(df, value, by, bins).join(counts, by), by, bins)
    spread = F.col("w") * (1 - F.col("w"))
    between = F.when(spread > 1e-15, F.pow(F.col("mt") * F.col("w") - F.col("m"), F.lit(2.0)) / spread).otherwise(0.0)
    group = Window.partitionBy(*by)
    rows = rows.withColumn("s", between).withColumns(
        {"top": F.max("s").over(group), "total": F.sum(F.col("p") * F.pow(F.col("x") - F.col("mt"), F.lit(2.0))).over(group)}
    )
    near = F.col("s") >= F.col("top") * (1 - 1e-9)
    run = F.sum(F.when(near, 0).otherwise(1)).over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"near": near, "run": run})
    first = F.min(F.when(F.col("s") == F.col("top"), F.col("bin"))).over(group)
    rows = rows.withColumn("home", F.max(F.when(F.col("bin") == first, F.col("run"))).over(group))
    flat = rows.where("near AND run = home").groupBy(*by).agg(
        F.floor((F.min("bin") + F.max("bin")) / 2).cast("int").alias("bin"), F.max("lo").alias("lo"), F.max("hi").alias("hi")
    )
    chosen = flat.join(rows.select(*by, "bin", "s", "total"), [*by, "bin"])
    quality = F.when(F.col("total") > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / F.col("total")))).otherwise(0.0)
    return chosen.select(*by, _centre(bins).alias("threshold"), quality.alias("quality"))


def multilevel_otsu(df: DataFrame, value: str, by: list[str], bins: int = 128) -> DataFrame:
    """by, low, high, quality: the two cuts of three classes, over all ordered pairs of bins."""
    rows = _shares(histogram(df, value, by, bins), by, bins)
    total = F.sum(F.col("p") * F.pow(F.col("x") - F.col("mt"), F.lit(2.0))).over(Window.partitionBy(*by))
    rows = rows.withColumn("total", total)
    left = rows.select(*by, *[F.col(c).alias(c + "i") for c in ("bin", "w", "m", "x")])
    right = rows.select(*by, *[F.col(c).alias(c + "j") for c in ("bin", "w", "m", "x")], "mt", "total")
    pairs = left.join(right, by).where("binj > bini")  # as many as bins allow, whatever the values
    w = [F.col("wi"), F.col("wj") - F.col("wi"), 1 - F.col("wj")]
    m = [F.col("mi"), F.col("mj") - F.col("mi"), F.col("mt") - F.col("mj")]
    pairs = pairs.where((w[0] > 1e-12) & (w[1] > 1e-12) & (w[2] > 1e-12))
    score = sum((F.pow(mk - wk * F.col("mt"), F.lit(2.0)) / wk for wk, mk in zip(w, m)), F.lit(0.0))
    # Rounded, so that pairs that differ by the order of additions alone tie; the first wins.
    order = F.struct(F.round(score, 12), -F.col("bini"), -F.col("binj"))
    best = pairs.groupBy(*by).agg(F.max_by(F.struct("xi", "xj", score.alias("s"), "total"), order).alias("b"))
    quality = F.when(F.col("b.total") > 1e-12, F.least(F.lit(1.0), F.col("b.s") / F.col("b.total"))).otherwise(0.0)
    return best.select(*by, F.col("b.xi").alias("low"), F.col("b.xj").alias("high"), quality.alias("quality"))


def mode_prominence(df: DataFrame, value: str, cuts: DataFrame, by: list[str], cut: str, bins: int = 128) -> DataFrame:
    """by, prominence: how far the histogram falls between the peaks on either side of a cut.

    1 minus saddle over the lower peak, on a histogram smoothed over five bins (bins outside count
    as empty). 0 for fewer than 100 values, no range, or a cut outside the bins' centres.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("valid"))
    group = Window.partitionBy(*by)
    near = group.orderBy("bin").rowsBetween(-2, 2)
    rows = histogram(df, value, by, bins).withColumns({"d": F.sum("n").over(near) / 5, "x": _centre(bins)})
    rows = rows.join(cuts.select(*by, F.col(cut).alias("cut")), by)
    side = F.when(F.col("x") < F.col("cut"), F.lit("l")).otherwise(F.lit("r"))
    peak = F.struct("d", -F.col("bin"))
    rows = rows.withColumn("side", side).withColumns(
        {
            "lp": F.max_by("bin", F.when(F.col("side") == "l", peak)).over(group),
            "rp": F.max_by("bin", F.when(F.col("side") == "r", peak)).over(group),
            "ld": F.max(F.when(F.col("side") == "l", F.col("d"))).over(group),
            "rd": F.max(F.when(F.col("side") == "r", F.col("d"))).over(group),
        }
    )
    found = rows.where("lp IS NOT NULL AND rp IS NOT NULL AND bin BETWEEN lp AND rp").groupBy(*by).agg(
        F.min("d").alias("saddle"), F.least(F.max("ld"), F.max("rd")).alias("peak")
    )
    depth = F.when(
        (F.col("valid") >= 100) & (F.col("peak") > 1e-12),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("saddle") / F.col("peak"))),
    )
    return counts.join(found, by, "left").select(*by, F.coalesce(depth, F.lit(0.0)).alias("prominence"))


def _sarle() -> Column:
    """Sarle's coefficient from the columns valid, sd, skew and kurt."""
    n = F.col("valid").cast("double")
    small = F.try_divide(3 * F.pow(n - 1, F.lit(2.0)), (n - 2) * (n - 3))
    ratio = F.try_divide(F.pow("skew", F.lit(2.0)) + 1, F.col("kurt") + small)
    judged = F.when((n >= 32) & (F.col("sd") >= 1e-12), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))
    return F.coalesce(judged, F.lit(0.0))


def bimodality(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, bimodality: Sarle's coefficient, 0 for fewer than 32 values or none that differ."""
    moments = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("valid"),
        F.stddev_pop(value).alias("sd"),
        F.skewness(value).alias("skew"),
        F.kurtosis(value).alias("kurt"),
    )
    return moments.select(*by, _sarle().alias("bimodality"))


def separability(df: DataFrame, value: str, mask: Column, by: list[str]) -> DataFrame:
    """by, separability: half the standardised mean difference inside and outside ``mask``."""
    x, inside = F.col(value), F.when(F.col(value).isNotNull(), mask)
    agg = df.groupBy(*by).agg(
        *[f(F.when(side, x)).alias(n + s) for side, s in ((inside, "1"), (~inside, "0")) for f, n in ((F.avg, "a"), (F.var_pop, "v"), (F.count, "n"))]
    )
    pooled = F.sqrt(0.5 * (F.col("v1") + F.col("v0")))
    gap = F.abs(F.col("a1") - F.col("a0"))
    alike = F.when(gap > 1e-9, 1.0).otherwise(0.0)
    out = F.when((F.col("n1") < 8) | (F.col("n0") < 8), 0.0).when(pooled < 1e-9, alike)
    return agg.select(*by, out.otherwise(F.least(F.lit(1.0), F.try_divide(gap, pooled) / 2)).alias("separability"))


def outlier_bound(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, bound: median plus three robust deviations; a strict comparison goes with it.

    Where the deviation is zero, the next larger number than the median.
    """
    valid = df.where(F.col(value).isNotNull())
    middle = valid.groupBy(*by).agg(F.median(value).alias("middle"))
    off = valid.join(middle, by).groupBy(*by).agg(
        F.max("middle").alias("middle"), F.median(F.abs(F.col(value) - F.col("middle"))).alias("mad")
    )
    following = F.col("middle") + F.greatest(F.abs("middle") * 1.2e-16, F.lit(5e-324))
    bound = F.when(F.col("mad") > 0, F.col("middle") + OUTLIER_SIGMAS * MAD_TO_SIGMA * F.col("mad")).otherwise(following)
    return off.select(*by, bound.alias("bound"))


@dataclass(frozen=True)
class Cut:
    """A cut that is wanted: of ``value`` (null: not in it), else ``fallback``.

    For a ``region`` (values that are left of a scene) the fallback is raised to the median, but
    stays for fewer than 16 values.
    """

    name: str
    value: Column
    fallback: float
    region: bool = False


def adaptive_thresholds(df: DataFrame, cuts: list[Cut], by: list[str], bins: int = 256) -> DataFrame:
    """by, and of each cut NAME, NAME_method and NAME_quality: Otsu's cut where the histogram
    justifies it.

    That takes a quality of 0.55 and a bimodality of 5/9; else the fallback, method ``literature``.
    All cuts take two passes: one aggregate for counts, bounds and moments, one for the bins. Empty
    bins are never made: a bin that has values stands for those up to the next one, which have its
    score. Every group of ``df`` has a row.
    """
    x = {c.name: c.value.cast("double") for c in cuts}
    measured = {
        c.name: F.struct(
            F.count(x[c.name]).alias("valid"),
            F.min(x[c.name]).alias("lo"),
            F.max(x[c.name]).alias("hi"),
            F.stddev_pop(x[c.name]).alias("sd"),
            F.skewness(x[c.name]).alias("skew"),
            F.kurtosis(x[c.name]).alias("kurt"),
            (F.median(x[c.name]) if c.region else F.lit(None).cast("double")).alias("middle"),
        )
        for c in cuts
    }
    whole = df.groupBy(*by).agg(*[m.alias("_m_" + n) for n, m in measured.items()])

    def binned(c: Cut) -> Column:
        m, v = F.col("_m_" + c.name), x[c.name]
        at = F.least(F.floor((v - m["lo"]) / (m["hi"] - m["lo"]) * bins), F.lit(bins - 1)).cast("int")
        return F.struct(F.lit(c.name).alias("name"), F.when(v.isNotNull() & (m["hi"] - m["lo"] >= 1e-9), at).alias("bin"), m.alias("m"))

    placed = df.join(whole, by).select(*by, F.explode(F.array(*[binned(c) for c in cuts])).alias("b"))
    stats = ("valid", "lo", "hi", "sd", "skew", "kurt", "middle")
    key = [*by, "name"]
    rows = placed.groupBy(*by, "b.name", "b.bin").agg(F.count("*").alias("n"), *[F.max("b.m." + f).alias(f) for f in stats])

    group = Window.partitionBy(*key)
    upto = group.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    n = F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0)
    rows = rows.withColumns({"p": F.try_divide(n, F.sum(n).over(group)), "x": _centre(bins)})
    rows = rows.withColumns({"w": F.sum("p").over(upto), "m": F.sum(F.col("p") * F.col("x")).over(upto)})
    rows = rows.withColumns({"mt": F.sum(F.col("p") * F.col("x")).over(group), "next": F.lead("bin").over(group.orderBy(F.col("bin").asc_nulls_first()))})
    spread = F.col("w") * (1 - F.col("w"))
    between = F.when(spread > 1e-15, F.pow(F.col("mt") * F.col("w") - F.col("m"), F.lit(2.0)) / spread).otherwise(0.0)
    rows = rows.withColumn("s", F.when((F.col("valid") >= 16) & F.col("bin").isNotNull(), between))
    rows = rows.withColumns({"top": F.max("s").over(group), "total": F.sum(F.col("p") * F.pow(F.col("x") - F.col("mt"), F.lit(2.0))).over(group)})
    near = F.col("s") >= F.col("top") * (1 - 1e-9)
    ordered = group.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"near": near, "run": F.sum(F.when(near, 0).otherwise(1)).over(ordered), "first": F.min(F.when(F.col("s") == F.col("top"), F.col("bin"))).over(group)})
    rows = rows.withColumn("home", F.max(F.when(F.col("bin") == F.col("first"), F.col("run"))).over(group))
    last = F.coalesce(F.col("next") - 1, F.lit(bins - 1))
    own = F.col("near") & (F.col("run") == F.col("home"))
    rows = rows.withColumns({"last": last, "mid": F.floor((F.min(F.when(own, F.col("bin"))).over(group) + F.max(F.when(own, last)).over(group)) / 2)})
    chosen = F.when((F.col("bin") <= F.col("mid")) & (F.col("mid") <= F.col("last")), F.col("s"))
    found = rows.groupBy(*key).agg(F.max("mid").alias("bin"), F.max(chosen).alias("s"), F.max("total").alias("total"), *[F.max(f).alias(f) for f in stats])

    quality = F.when(F.col("bin").isNotNull(), F.when(F.col("total") > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / F.col("total")))).otherwise(0.0))
    good = F.coalesce((quality >= MIN_QUALITY) & (_sarle() >= BIMODAL_FROM), F.lit(False))
    fallbacks = F.create_map(*[v for c in cuts for v in (F.lit(c.name), F.lit(float(c.fallback)))])
    raised = F.col("name").isin(*[c.name for c in cuts if c.region]) & (F.col("valid") >= 16)
    other = F.when(raised, F.greatest(fallbacks[F.col("name")], F.col("middle"))).otherwise(fallbacks[F.col("name")])
    judged = found.select(
        *key,
        F.when(good, _centre(bins)).otherwise(other).alias("threshold"),
        F.when(good, "otsu").otherwise("literature").alias("method"),
        F.coalesce(quality, F.lit(0.0)).alias("quality"),
    )
    mine = lambda c, f: F.max(F.when(F.col("name") == c.name, F.col(f)))
    fields = (("threshold", ""), ("method", "_method"), ("quality", "_quality"))
    return judged.groupBy(*by).agg(*[mine(c, f).alias(c.name + end) for c in cuts for f, end in fields])


def adaptive_threshold(df: DataFrame, value: str, by: list[str], fallback: float, region: bool = False) -> DataFrame:
    """by, threshold, method, quality of one cut; see ``adaptive_thresholds``."""
    found = adaptive_thresholds(df, [Cut("t", F.col(value), fallback, region)], by)
    return found.select(*by, F.col("t").alias("threshold"), F.col("t_method").alias("method"), F.col("t_quality").alias("quality"))


def fill_invalid(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with the nulls of ``value`` replaced by its group's median, or by 0 if it has none."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_middle"))
    return df.join(middle, by).withColumn(value, F.coalesce(value, "_middle", F.lit(0.0))).drop("_middle")


def stretch(df: DataFrame, value: str, by: list[str], low: float, high: float, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` stretched to [0, 1] between two percentiles of its group.

    All zero if the range is below 1e-12; null stays null.
    """
    ends = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("ends"))
    lo, hi = F.col("ends")[0], F.col("ends")[1]
    scaled = F.when(hi - lo >= 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - lo) / (hi - lo)))).otherwise(0.0)
    return df.join(ends, by).withColumn(out, F.when(F.col(value).isNotNull(), scaled)).drop("ends")
