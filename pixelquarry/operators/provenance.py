"""What happened to an analysis, as one column that its operators append to and that is reduced at the end.

An entry is a step that ran, a line of evidence, a warning or a factor of confidence. Everything that is
said of an analysis (warnings, confidence, evidence, steps, status) is folded from that array in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.binding import bound
from pixelquarry.operators import confidence

COLUMN = "provenance"
ENTRY = "struct<kind:string,source:string,name:string,value:double,weight:double,text:string,ms:bigint>"
#: What a step came to (fixed values).
OK, WARNED = "ok", "warning"


def started(df: DataFrame) -> DataFrame:
    return df.withColumn(COLUMN, F.array().cast(f"array<{ENTRY}>"))


def _entry(kind: str | Column, source: str, **parts: Column) -> Column:
    """An entry; what isn't given is null."""
    given = {"kind": F.lit(kind) if isinstance(kind, str) else kind, "source": F.lit(source), **parts}
    kinds = (part.split(":") for part in ENTRY.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


def with_entries(df: DataFrame, entries: Column) -> DataFrame:
    """``df`` with an array of entries at the end of its provenance; a null one adds none."""
    return df.withColumn(COLUMN, F.concat(COLUMN, F.coalesce(F.array_compact(entries), F.array().cast(f"array<{ENTRY}>"))))


def step(df: DataFrame, source: str, details: Column, ms: int | None = None, warned: Column | None = None) -> DataFrame:
    """A step that ran; ``warned`` says whether it did so with a warning."""
    state = F.lit(OK) if warned is None else F.when(warned, WARNED).otherwise(OK)
    return with_entries(df, F.array(_entry("step", source, name=state, text=details, ms=F.lit(ms))))


def warn(df: DataFrame, source: str, codes: Column) -> DataFrame:
    """Warnings, by their codes (an array)."""
    return with_entries(df, F.transform(codes, lambda c: _entry("warning", source, text=c)))


def observe(df: DataFrame, source: str, lines: Column) -> DataFrame:
    """Lines of evidence (an array of texts)."""
    return with_entries(df, F.transform(lines, lambda t: _entry("line", source, text=t)))


def weigh(df: DataFrame, source: str, factors: Column) -> DataFrame:
    """Factors of confidence (an array of structs), gates as such."""
    kind = lambda f: F.when(f["kind"] == "gate", "gate").otherwise("factor")
    return with_entries(df, F.transform(factors, lambda f: _entry(kind(f), source, name=f["name"], value=f["value"], weight=f["weight"], text=f["reason"])))


def _of(p: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(p, lambda e: e["kind"].isin(*kinds))


def _codes(p: Column) -> Column:
    return F.array_distinct(F.transform(_of(p, ("warning",)), lambda e: e["text"]))


def warnings() -> Column:
    """The codes of all warnings so far, each once, where it came first."""
    return _codes(F.col(COLUMN))


def reduced(df: DataFrame) -> DataFrame:
    """``df`` with its provenance folded: warnings, score, level, limiting_factor, reasons, evidence (lines,
    then factors: type, source, value, description), steps (step, status, details, ms) and status."""
    name = lambda e: F.when(e["kind"] == "line", "observation").when(e["kind"] == "gate", "quality").otherwise("measurement")

    def folded(v: Column) -> Column:
        p = v["p"]
        factors = F.transform(_of(p, ("factor", "gate")), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"), e["weight"].alias("weight"), e["kind"].alias("kind"), e["text"].alias("reason")))
        said = lambda kinds: F.transform(_of(p, kinds), lambda e: F.struct(name(e).alias("type"), F.concat_ws(":", e["source"], e["name"]).alias("source"), confidence.clamped_or_null(e["value"]).alias("value"), e["text"].alias("description")))
        steps = F.transform(_of(p, ("step",)), lambda e: F.struct(e["source"].alias("step"), e["name"].alias("status"), e["text"].alias("details"), e["ms"].alias("ms")))
        return F.struct(_codes(p).alias("warnings"), confidence.folded(factors).alias("c"), F.concat(said(("line",)), said(("factor", "gate"))).alias("evidence"), steps.alias("steps"))

    rows = df.withColumn("_r", bound(folded, p=F.col(COLUMN)))
    rows = rows.select("*", "_r.warnings", "_r.evidence", "_r.steps", "_r.c.*").drop("_r", COLUMN)
    return rows.withColumn("status", confidence.status(F.col("level") == "insufficient", F.size("warnings")))
