"""What scenes look like: palettes, legends, masks over pictures, boxes and thumbnails, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: class code -> colour (our own).
CLASS_COLOURS = {0: "#000000", 1: "#2b6cb0", 2: "#2f855a", 3: "#c53030", 4: "#b7791f"}
#: Colours of a heat map at equal steps from 0 to 1 (our own).
HEAT = ((13, 8, 84), (84, 39, 143), (199, 75, 102), (246, 151, 56), (240, 240, 80))
#: How much of a mask's colour covers the picture.
ALPHA = 0.45


def channel(value: Column, k: int, stops: tuple = HEAT) -> Column:
    """Channel ``k`` (0 to 255) of a value from 0 to 1: straight lines between the stops; null stays."""
    steps = len(stops) - 1
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * steps
    at = F.least(F.floor(x), F.lit(steps - 1)).cast("int")
    low, high = (F.element_at(F.array(*[F.lit(float(s[k])) for s in stops]), at + 1 + d) for d in (0, 1))
    return F.when(value.isNotNull(), F.floor(low + (high - low) * (x - at) + 0.5).cast("int"))


def heat_map(px: DataFrame, value: str) -> DataFrame:
    """``px`` with red8, green8 and blue8 of ``value`` (0 to 1); invalid pixels are black."""
    return px.withColumns({n: F.coalesce(channel(F.col(value), k), F.lit(0)) for k, n in enumerate(("red8", "green8", "blue8"))})


def legend(stats: DataFrame, by: list[str] = ["scene_id"]) -> DataFrame:
    """by, class_code, colour and fraction of the classes that a map shows, in order of their codes."""
    colour = F.coalesce(*[F.when(F.col("class_code") == k, c) for k, c in CLASS_COLOURS.items()])
    counts = stats.groupBy(*by, "class_code").agg(F.count("*").alias("n"))
    return counts.select(*by, "class_code", colour.alias("colour"), (F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("fraction"))


def outlined(px: DataFrame, mask: str, by: list[str] = ["scene_id"]) -> DataFrame:
    """``px`` with edge: whether a pixel of ``mask`` has one of its four neighbours outside of it.

    The frame's own border is no edge.
    """
    inside = F.coalesce(F.col(mask), F.lit(False))
    rows = px.withColumn("_in", inside)
    along = Window.partitionBy(*by, "r").orderBy("c")
    down = Window.partitionBy(*by, "c").orderBy("r")
    out = lambda f, w: ~F.coalesce(f("_in").over(w), F.lit(True))
    rows = rows.withColumn("_across", out(F.lag, along) | out(F.lead, along))
    rows = rows.withColumn("_down", out(F.lag, down) | out(F.lead, down))
    return rows.withColumn("edge", F.col("_in") & (F.col("_across") | F.col("_down"))).drop("_in", "_across", "_down")


def overlaid(px: DataFrame, channels: list[str], mask: str, colour: tuple[int, int, int], by: list[str] = ["scene_id"]) -> DataFrame:
    """``px`` with its ``channels`` covered by ``colour`` in part where ``mask`` is, wholly on its outline."""
    rows = outlined(px, mask, by)
    for name, full in zip(channels, colour, strict=True):
        mixed = F.floor(F.col(name) * (1 - ALPHA) + full * ALPHA + 0.5).cast("int")
        rows = rows.withColumn(name, F.when(F.col("edge"), F.lit(full)).when(F.col(mask), mixed).otherwise(F.col(name)))
    return rows


def boxed(px: DataFrame, regions: DataFrame, by: list[str] = ["scene_id"]) -> DataFrame:
    """``px`` with on_box: whether a pixel lies on the border of any region's box.

    A box becomes its border pixels, which meet the scene's pixels by place; a region in a large
    scene has as many as its box is wide and high.
    """
    r0, c0, r1, c1 = (F.col(x) for x in ("r0", "c0", "r1", "c1"))
    rows, columns = F.sequence(r0, r1 - 1), F.sequence(c0, c1 - 1)
    place = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    border = F.concat(
        F.transform(columns, lambda c: place(r0, c)), F.transform(columns, lambda c: place(r1 - 1, c)),
        F.transform(rows, lambda r: place(r, c0)), F.transform(rows, lambda r: place(r, c1 - 1)),
    )
    on = regions.select(*by, F.explode(border).alias("p")).select(*by, "p.r", "p.c").distinct().withColumn("on_box", F.lit(True))
    return px.join(on, [*by, "r", "c"], "left").withColumn("on_box", F.coalesce("on_box", F.lit(False)))


def thumbnail(px: DataFrame, channels: list[str], factor: int, by: list[str] = ["scene_id"]) -> DataFrame:
    """by, r, c and the channels' means over squares of ``factor`` pixels; null counts for nothing."""
    place = [F.floor(F.col(x) / F.lit(float(factor))).cast("int").alias(x) for x in ("r", "c")]
    return px.groupBy(*by, *place).agg(*[F.floor(F.avg(n) + 0.5).cast("int").alias(n) for n in channels])
