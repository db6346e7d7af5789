"""Confidence from factors: a weighted mean that no gate may exceed.

An analysis's factors are an array in its row, and all that is said of them is folded there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.binding import bound

#: Weights of the shared factors, and least scores of the levels (fixed values).
WEIGHTS = {"evidence": 0.45, "quality": 0.25, "registration": 0.20, "attribution": 0.15, "warnings": 0.10}
FACTORS = "array<struct<name:string,value:double,weight:double,kind:string,reason:string>>"
LEVELS = (("high", 0.75), ("medium", 0.50), ("low", 0.25))


def clamped(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def clamped_or_null(value: Column) -> Column:
    return F.when(value.isNotNull(), clamped(value))


def folded(factors: Column) -> Column:
    """score, level, limiting_factor and reasons of an array of factors, as a struct; null factors have none.

    The score is the weighted mean (the plain mean where no factor has weight), or the lowest gate if
    that is lower. The limiting factor is the lowest gate below the mean, else the lowest factor that
    has weight, else the lowest of all; the first one in order on ties. Reasons say what the factors
    say, weakest first. Without factors the score is 0 and the answer insufficient.
    """
    ranked = lambda f, k: F.struct(clamped(f["value"]).alias("v"), k.alias("k"), f["name"].alias("name"), F.greatest(f["weight"], F.lit(0.0)).alias("w"), (f["kind"] == "gate").alias("gate"), f["reason"].alias("reason"))
    total = lambda x, of: F.aggregate(x, F.lit(0.0), lambda s, f: s + of(f))

    def weighed(p: Column) -> Column:
        x = p["x"]
        weight = total(x, lambda f: f["w"])
        mean = F.when(weight > 0, total(x, lambda f: f["v"] * f["w"]) / weight).otherwise(F.try_divide(total(x, lambda f: f["v"]), F.size(x)))
        order = F.array_sort(x)
        first = lambda test: F.get(F.filter(order, test), F.lit(0))
        low = F.coalesce(first(lambda f: f["w"] > 0), F.get(order, F.lit(0)))
        return bound(judged, mean=F.coalesce(mean, F.lit(0.0)), gate=first(lambda f: f["gate"]), low=low, said=F.transform(order, lambda f: f["reason"]))

    def judged(p: Column) -> Column:
        score = F.least(p["mean"], F.coalesce(p["gate"]["v"], p["mean"]))
        limiting = F.when(p["gate"]["v"] < p["mean"], p["gate"]["name"]).otherwise(p["low"]["name"])
        return F.struct(score.alias("score"), level(score).alias("level"), limiting.alias("limiting_factor"), p["said"].alias("reasons"))

    return bound(weighed, x=F.transform(F.coalesce(factors, F.array().cast(FACTORS)), ranked))


def assessed(df: DataFrame, factors: Column) -> DataFrame:
    """``df`` with score, level, limiting_factor and reasons; no row moves."""
    return df.withColumn("_folded", folded(factors)).select("*", "_folded.*").drop("_folded")


def level(score: Column) -> Column:
    out = F.lit("insufficient")
    for name, least in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def bimodality_signal(b: Column) -> Column:
    """0 at a normal distribution's coefficient, 1 at a uniform one's."""
    low, high = 1.0 / 3.0, 5.0 / 9.0
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (b - low) / (high - low)))


def warning_value(n: Column) -> Column:
    return F.greatest(1 - 0.15 * n, F.lit(0.4))


def factor(name: str, value: Column, weight: float, kind: str = "contributor", reason: Column | None = None) -> Column:
    """A factor as a struct; ``reason`` says what was measured (default: name and value)."""
    value = value.cast("double")
    said = F.format_string(name.replace("_", " ") + " scored %.2f", F.round(value, 2)) if reason is None else reason
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(float(weight)).alias("weight"), F.lit(kind).alias("kind"), said.alias("reason"))


def known(*factors: Column) -> Column:
    """The factors whose value is known, in order."""
    return F.filter(F.array(*factors), lambda f: f["value"].isNotNull())


def shared(df: DataFrame) -> list[Column]:
    """The factors that every analysis has: warnings, and the inputs' quality where it was assessed."""
    found = [factor("warnings", warning_value(F.col("n_warnings")), WEIGHTS["warnings"])]
    return found + ([factor("input_quality", F.col("quality"), WEIGHTS["quality"])] if "quality" in df.columns else [])


def registration_score(offset: Column, ncc: Column, response: Column) -> Column:
    """What a pair's measured offset, structure and peak are worth, 0 to 1."""
    part = 0.5 * F.greatest(F.lit(0.0), 1 - offset / 10) + 0.35 * F.greatest(ncc, F.lit(0.0)) + 0.15 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), response))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))


def for_change(df: DataFrame) -> Column:
    """Factors of a change result: bimodality, corroborated, registration, threshold_quality,
    attribution (null where no conversion is named), n_warnings."""
    evidence = F.least(bimodality_signal(F.col("bimodality")), F.col("corroborated"))
    own = [
        factor("evidence_strength", evidence, WEIGHTS["evidence"], "gate"),
        factor("registration", F.col("registration"), WEIGHTS["registration"], "gate"),
        factor("threshold_quality", F.col("threshold_quality"), WEIGHTS["quality"]),
    ]
    if "attribution" in df.columns:
        own.append(factor("semantic_attribution", F.col("attribution"), WEIGHTS["attribution"]))
    return known(*own, *shared(df))


def for_landcover(df: DataFrame) -> Column:
    """Factors of a land-cover result: separability, n_warnings."""
    return known(factor("class_separability", F.col("separability"), WEIGHTS["evidence"], "gate"), *shared(df))


def for_sar(df: DataFrame) -> Column:
    """Factors of a radar result: prominence (null: nothing separated), speckle_reduction, n_warnings."""
    separation = F.coalesce(F.least(F.col("prominence") / 0.5, F.lit(1.0)), F.lit(0.6))
    speckle = F.least(F.col("speckle_reduction") / 2, F.lit(1.0))
    return known(factor("regime_separation", separation, WEIGHTS["evidence"]), factor("speckle_reduction", speckle, WEIGHTS["registration"]), *shared(df))


def for_fusion(df: DataFrame) -> Column:
    """Factors of a fused result: corroborated, agreement, registration, n_warnings."""
    own = [
        factor("corroboration", F.col("corroborated"), WEIGHTS["evidence"], "gate"),
        factor("sensor_agreement", F.col("agreement"), WEIGHTS["quality"]),
        factor("registration", F.col("registration"), WEIGHTS["registration"]),
    ]
    return known(*own, *shared(df))


def for_grounding(df: DataFrame) -> Column:
    """Factors of a grounding: separability, count_reportable, n_warnings. A count that is withheld
    is a reason without weight: the extent is as sure as ever."""
    own = [factor("class_separability", F.col("separability"), WEIGHTS["evidence"], "gate"), *shared(df)]
    withheld = factor("count_reportable", F.when(~F.col("count_reportable"), 1.0), 0.0, reason=F.lit("the number of regions is withheld"))
    return known(own[0], own[1], withheld, *own[2:])


def for_scene(df: DataFrame) -> Column:
    """Factors of a learned scene class: probability, margin, test_accuracy and separability (null:
    not measured), n_warnings."""
    own = [factor("model_probability", F.col("probability"), WEIGHTS["evidence"], "gate"), factor("model_margin", F.col("margin"), WEIGHTS["attribution"])]
    rest = [factor("model_test_accuracy", F.col("test_accuracy"), WEIGHTS["attribution"]), factor("class_separability", F.col("separability"), WEIGHTS["registration"])]
    return known(*own, *shared(df)[:1], *rest, *shared(df)[1:])


def evidence(lines: Column, tool: Column, factors: Column) -> Column:
    """An analysis's lines as observations, then its factors as measurements, or as quality where they
    gate: an array of type, source, value, description."""
    item = lambda kind, source, value, said: F.struct(kind.alias("type"), source.alias("source"), value.alias("value"), said.alias("description"))
    observed = F.transform(lines, lambda x: item(F.lit("observation"), tool, F.lit(None).cast("double"), x))
    measured = F.transform(factors, lambda f: item(F.when(f["kind"] == "gate", "quality").otherwise("measurement"), F.concat_ws(":", tool, f["name"]), clamped(f["value"]), f["reason"]))
    return F.concat(observed, measured)


def status(insufficient: Column, n_warnings: Column) -> Column:
    return F.when(insufficient | (n_warnings > 0), "partial").otherwise("success")


def distinct_in_order(*lists: Column) -> Column:
    """Warnings of several steps, each once, where it came first."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))
