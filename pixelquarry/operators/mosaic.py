"""Masks and regions of scenes that are larger than one group: tiles, halos and merged borders.

``neighbourhood`` holds a scene in one task. Here a group is a tile of ``EDGE`` by ``EDGE`` pixels, whatever the
size of its scene, and results are the same. Morphology gives each tile the pixels around it that its result
depends on. Components are found tile by tile and named by their first pixel; only pixels on tile borders meet
those of the next tile, and the links between names are contracted to stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.operators.neighbourhood import clean_grid, label
from pixelquarry.operators.staging import discard, staged, staged_at

EDGE = 1024
#: Bits of a place's number that hold its column.
_SHIFT = 31


def place(r: Column, c: Column) -> Column:
    """A pixel's number within its scene, in raster order."""
    return F.shiftleft(r.cast("long"), _SHIFT) + c


def _tile(axis: Column, edge: int) -> Column:
    return F.floor(axis / F.lit(edge)).cast("int")


def clean_masks(px: DataFrame, masks: list[str], open_radius: int = 1, close_radius: int = 2, min_area: int = 0, edge: int = EDGE, scene: str = "scene_id") -> DataFrame:
    """scene, r, c and the ``masks``, as ``neighbourhood.clean_masks`` cleans them, tile by tile.

    Null counts as outside. A pixel goes to its tile and to those whose result it can reach: the halo is as
    wide as the four passes together, so what is unknown beyond it never comes to the tile itself.
    """
    halo = 2 * (open_radius + close_radius)
    if halo > edge:
        raise ValueError("a tile is at least as long as its halo")
    size = px.groupBy(scene).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    near = lambda axis: F.array_distinct(F.array(*[_tile(F.col(axis) + d, edge) for d in (-halo, 0, halo)]))
    flags = [F.coalesce(F.col(m), F.lit(False)).alias(m) for m in masks]
    rows = px.select(scene, "r", "c", *flags).join(size, scene).withColumn("_tr", F.explode(near("r"))).withColumn("_tc", F.explode(near("c")))
    rows = rows.where((F.col("_tr") >= 0) & (F.col("_tc") >= 0) & (F.col("_tr") * edge < F.col("_h")) & (F.col("_tc") * edge < F.col("_w")))

    def run(table: pa.Table) -> pa.Table:
        at = {n: table.column(n).to_numpy() for n in ("r", "c")}
        tr, tc, h, w = (table.column(n)[0].as_py() for n in ("_tr", "_tc", "_h", "_w"))
        top, left = max(0, tr * edge - halo), max(0, tc * edge - halo)
        shape = min(h, (tr + 1) * edge + halo) - top, min(w, (tc + 1) * edge + halo) - left
        own = (at["r"] // edge == tr) & (at["c"] // edge == tc)
        spot = at["r"] - top, at["c"] - left
        out = table.filter(pa.array(own))
        for mask in masks:
            grid = np.zeros(shape, dtype=bool)
            grid[spot] = table.column(mask).to_numpy()
            found = clean_grid(grid, open_radius, close_radius, 0)[spot][own]
            out = out.set_column(out.schema.get_field_index(mask), mask, pa.array(found))
        return out.drop_columns(["_tr", "_tc", "_h", "_w"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_tr", "_tc", "_h", "_w").schema)
    cleaned = rows.groupBy(scene, "_tr", "_tc").applyInArrow(run, ddl)
    if min_area <= 1:
        return cleaned
    cleaned = staged(cleaned)
    for mask in masks:
        named = named_components(cleaned, mask, edge, scene)
        large = named.groupBy(scene, "name").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_area)
        kept = named.join(large, [scene, "name"], "left_semi").select(scene, "r", "c", F.lit(True).alias("_kept"))
        cleaned = cleaned.join(kept, [scene, "r", "c"], "left").withColumn(mask, F.coalesce("_kept", F.lit(False))).drop("_kept")
    return cleaned


def _local(px: DataFrame, mask: str, edge: int, scene: str) -> DataFrame:
    """scene, r, c, name: components within each tile, each named by its first pixel."""

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
        top, left = r.min(), c.min()
        grid = np.zeros((r.max() - top + 1, c.max() - left + 1), dtype=bool)
        grid[r - top, c - left] = True
        number = label(grid)[r - top, c - left]
        first = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, number, (r << _SHIFT) + c)
        return table.select([scene, "r", "c"]).append_column("name", pa.array(first[number]))

    rows = px.where(F.col(mask)).select(scene, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    ddl = f"`{scene}` {px.schema[scene].dataType.simpleString()}, r int, c int, name long"
    return rows.groupBy(scene, _tile(F.col("r"), edge), _tile(F.col("c"), edge)).applyInArrow(lambda _, table: run(table), ddl)


def border_links(named: DataFrame, edge: int, scene: str = "scene_id") -> DataFrame:
    """scene, a, b: names (a over b) of components that touch across the border of two tiles."""
    within = lambda axis: F.col(axis) % edge
    rim = named.where((within("r") == 0) | (within("r") == edge - 1) | (within("c") == 0) | (within("c") == edge - 1))
    steps = F.array(*[F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    asked = rim.withColumn("_s", F.explode(steps)).select(scene, F.col("name").alias("_own"), F.col("r").alias("_r"), F.col("c").alias("_c"), (F.col("r") + F.col("_s.r")).alias("r"), (F.col("c") + F.col("_s.c")).alias("c"))
    asked = asked.where((_tile(F.col("r"), edge) != _tile(F.col("_r"), edge)) | (_tile(F.col("c"), edge) != _tile(F.col("_c"), edge)))
    met = asked.join(rim, [scene, "r", "c"]).where(F.col("_own") != F.col("name"))
    return met.select(scene, F.greatest("_own", "name").alias("a"), F.least("_own", "name").alias("b")).distinct()


def contracted(links: DataFrame, scene: str = "scene_id") -> DataFrame:
    """scene, a, b with b the smallest name that a reaches, for every a that isn't the smallest of its own.

    Large-star and small-star steps in turn, each one aggregate and one join by name, until every link leads to
    a name that has no smaller one. A round reads the table that the last one wrote, which then goes.
    """
    spark = links.sparkSession
    now, path = staged_at(links)
    while True:
        both = now.select(scene, "a", "b").unionByName(now.select(scene, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(scene, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, [scene, "a"]).where("b > a").select(scene, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy(scene, "a").agg(F.min("b").alias("m"))
        hung = large.join(lower, [scene, "a"]).where("b > m").select(scene, F.col("b").alias("a"), F.col("m").alias("b"))
        after, next_path = staged_at(hung.unionByName(lower.withColumnRenamed("m", "b")).distinct())
        discard(spark, path)
        now, path = after, next_path
        inner = now.join(now.select(scene, F.col("a").alias("b")), [scene, "b"], "left_semi")
        if inner.isEmpty():
            return now


def named_components(px: DataFrame, mask: str, edge: int = EDGE, scene: str = "scene_id") -> DataFrame:
    """scene, r, c, name: the 8-connected components of ``mask``, each named by the ``place`` of its first pixel."""
    local = staged(_local(px, mask, edge, scene))
    roots = contracted(border_links(local, edge, scene), scene).select(scene, F.col("a").alias("name"), F.col("b").alias("_root"))
    return local.join(roots, [scene, "name"], "left").select(scene, "r", "c", F.coalesce("_root", "name").alias("name"))


def components(px: DataFrame, mask: str, edge: int = EDGE, scene: str = "scene_id") -> DataFrame:
    """scene, r, c, label, as ``neighbourhood.components`` numbers them: from 1 by their first pixel.

    Components are counted by the image line of their first pixel, lines are summed up, and a line numbers its
    own: a window holds a line's components or a scene's lines, never all components of a scene.
    """
    named = staged(named_components(px, mask, edge, scene))
    line = F.shiftright("name", _SHIFT).alias("_line")
    firsts = named.where(place(F.col("r"), F.col("c")) == F.col("name")).select(scene, "name", line)
    before = Window.partitionBy(scene).orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    lines = firsts.groupBy(scene, "_line").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = firsts.withColumn("_at", F.row_number().over(Window.partitionBy(scene, "_line").orderBy("name"))).join(lines, [scene, "_line"])
    numbers = numbered.select(scene, "name", (F.col("_before") + F.col("_at")).cast("int").alias("label"))
    return named.join(numbers, [scene, "name"]).select(scene, "r", "c", "label")
