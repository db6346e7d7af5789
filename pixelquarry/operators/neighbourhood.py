"""Square neighbourhoods of pixels: padded windows, stencils, morphology and components.

Borders are part of the meaning, so the frame is padded with rows first and two one-dimensional
window passes follow, each sorted once by scene line. Kernels that need a whole scene at once run
grouped by scene; a scene is bounded by the reader's edge limit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _padded(df: DataFrame, axis: str, size: Column, reach: int, border: str) -> DataFrame:
    """``df`` with copies of its edge rows at positions -reach.. and size.. of ``axis``."""
    at = F.col(axis)
    if border == "replicate":
        first, last = F.when(at == 0, at - reach).otherwise(at), F.when(at == size - 1, at + reach).otherwise(at)
        return df.withColumn(axis, F.explode(F.sequence(first, last)))
    mirrored = F.array(at, F.when((at >= 1) & (at <= reach), -at), F.when((at <= size - 2) & (at >= size - 1 - reach), 2 * (size - 1) - at))
    return df.withColumn(axis, F.explode(F.array_compact(mirrored)))


def box_mean(px: DataFrame, values: list[str], window: int, border: str = "replicate", scene: str = "scene_id") -> DataFrame:
    """scene, r, c and the mean of each value over a ``window`` by ``window`` frame.

    ``border`` is ``replicate`` or ``reflect`` (without the edge itself). Null counts as zero: carry
    a validity column to tell. Every pixel of the frame must have a row.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("a window is odd and at least 3")
    reach = window // 2
    size = px.groupBy(scene).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    rows = px.select(scene, "r", "c", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]).join(size, scene)
    for axis, other, extent in (("c", "r", F.col("_w")), ("r", "c", F.col("_h"))):
        line = Window.partitionBy(scene, other).orderBy(axis).rowsBetween(-reach, reach)
        rows = _padded(rows, axis, extent, reach, border)
        rows = rows.withColumns({v: F.sum(v).over(line) for v in values}).where((F.col(axis) >= 0) & (F.col(axis) < extent))
    return rows.select(scene, "r", "c", *[(F.col(v) / (window * window)).alias(v) for v in values])


def stencils(px: DataFrame, value: str, kernels: dict[str, dict[tuple[int, int], float]], by: list[str] = ["scene_id"]) -> DataFrame:
    """``px`` with a column for each of ``kernels``: the weighted sum over offsets (row, column) of
    -1 to 1, reflecting at the border. Null counts as zero.

    Two passes of windows bring each pixel its eight neighbours, for all kernels at once.
    """
    size = px.groupBy(*by).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    rows = px.withColumn("_x0", F.coalesce(F.col(value).cast("double"), F.lit(0.0))).join(size, by)
    columns = {0: "_x0", -1: "_x1", 1: "_x2"}
    for axis, other, extent in (("c", "r", F.col("_w")), ("r", "c", F.col("_h"))):
        line = Window.partitionBy(*by, other).orderBy(axis)
        rows = _padded(rows, axis, extent, 1, "reflect")
        if axis == "c":
            rows = rows.withColumns({columns[-1]: F.lag("_x0").over(line), columns[1]: F.lead("_x0").over(line)})
        else:
            near = {(dr, dc): f(x).over(line) for dr, f in ((-1, F.lag), (1, F.lead)) for dc, x in columns.items()}
            near |= {(0, dc): F.col(x) for dc, x in columns.items()}
            sums = {name: sum((near[o] * F.lit(float(w)) for o, w in weights.items() if w), F.lit(0.0)) for name, weights in kernels.items()}
            rows = rows.withColumns(sums)
        rows = rows.where((F.col(axis) >= 0) & (F.col(axis) < extent))
    return rows.drop("_h", "_w", *columns.values())


_SOBEL_X = {(dr, dc): float(dc * (2 - abs(dr))) for dr in (-1, 0, 1) for dc in (-1, 1)}
_SOBEL_Y = {(dr, dc): float(dr * (2 - abs(dc))) for dr in (-1, 1) for dc in (-1, 0, 1)}
_LAPLACE = {(0, 0): -4.0, (0, 1): 1.0, (0, -1): 1.0, (1, 0): 1.0, (-1, 0): 1.0}


def gradient(px: DataFrame, value: str, out: str = "gradient", by: list[str] = ["scene_id"]) -> DataFrame:
    """``px`` with the magnitude of the 3 by 3 Sobel gradient."""
    rows = stencils(px, value, {"_gx": _SOBEL_X, "_gy": _SOBEL_Y}, by)
    return rows.withColumn(out, F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy")


def laplacian(px: DataFrame, value: str, out: str = "laplacian", by: list[str] = ["scene_id"]) -> DataFrame:
    return stencils(px, value, {out: _LAPLACE}, by)


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic element of edge 2 * radius + 1; of radius 1 it is a cross."""
    out = []
    for dr in range(-radius, radius + 1):
        width = round(radius * (1 - (dr / radius) ** 2) ** 0.5) if radius else 0
        out += [(dr, dc) for dc in range(-width, width + 1)]
    return out


def _shifted(mask: np.ndarray, dr: int, dc: int, fill: bool) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = mask[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def dilate(mask: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([_shifted(mask, dr, dc, False) for dr, dc in element])


def erode(mask: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_and.reduce([_shifted(mask, dr, dc, True) for dr, dc in element])


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components: 1, 2, ... in the order of their first pixel; 0 outside."""
    h, w = mask.shape
    none = h * w
    root = np.where(mask, np.arange(none).reshape(h, w), none)
    flat_mask = mask.reshape(-1)
    while True:
        padded = np.pad(root, 1, constant_values=none)
        best = np.minimum.reduce([padded[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
        best = np.where(mask, best, none).reshape(-1)
        for _ in range(4):  # follow roots of roots
            best[flat_mask] = np.minimum(best[flat_mask], best[best[flat_mask]])
        best = best.reshape(h, w)
        if (best == root).all():
            break
        root = best
    _, number = np.unique(root, return_inverse=True)
    return np.where(mask, number.reshape(h, w) + 1, 0)


def plane(table: pa.Table, column: str, fill: float | bool) -> np.ndarray:
    """One column of a scene's rows as its grid; missing places and nulls are ``fill``."""
    r, c = (table.column(x).to_numpy() for x in ("r", "c"))
    values = pc.fill_null(table.column(column).combine_chunks(), fill).to_numpy(zero_copy_only=False)
    out = np.full((int(r.max()) + 1, int(c.max()) + 1), fill, dtype=bool if isinstance(fill, bool) else np.float64)
    out[r, c] = values
    return out


def per_scene(px: DataFrame, by: list[str], kernel: Callable[[pa.Table], dict[str, np.ndarray]], schema: dict[str, str]) -> DataFrame:
    """``px`` with the columns of ``schema`` (name: type): grids that ``kernel`` makes of a scene.

    A scene, bounded by the reader's edge limit, is one group; its other columns pass through as
    they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in px.schema} | schema
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy() for x in ("r", "c"))
        for name, grid in kernel(table).items():
            column = pa.array(grid[r, c])
            at = table.schema.get_field_index(name)
            table = table.append_column(name, column) if at < 0 else table.set_column(at, name, column)
        return table.select(list(kinds))

    return px.groupBy(*by).applyInArrow(run, ddl)


def clean_grid(grid: np.ndarray, open_radius: int, close_radius: int, min_area: int) -> np.ndarray:
    if open_radius:
        grid = dilate(erode(grid, ellipse(open_radius)), ellipse(open_radius))
    if close_radius:
        grid = erode(dilate(grid, ellipse(close_radius)), ellipse(close_radius))
    if min_area > 1:
        numbers = label(grid)
        grid = grid & (np.bincount(numbers.reshape(-1))[numbers] >= min_area)
    return grid


def clean_masks(
    px: DataFrame, masks: list[str], open_radius: int = 1, close_radius: int = 2, min_area: int = 0, by: list[str] = ["scene_id"]
) -> DataFrame:
    """``px`` with its ``masks`` opened, closed and freed of components below ``min_area`` pixels.

    Null counts as outside; places outside the frame neither grow nor erode a mask.
    """
    clean = lambda t: {m: clean_grid(plane(t, m, False), open_radius, close_radius, min_area) for m in masks}
    return per_scene(px, by, clean, dict.fromkeys(masks, "boolean"))


def components(px: DataFrame, mask: str, scene: str = "scene_id") -> DataFrame:
    """scene, r, c, label of the pixels in ``mask``: 8-connected components of each scene, numbered
    from 1 by their first pixel."""
    numbered = per_scene(px.select(scene, "r", "c", mask), [scene], lambda t: {"label": label(plane(t, mask, False)).astype(np.int32)}, {"label": "int"})
    return numbered.where("label > 0").drop(mask)


def regions(px: DataFrame, labels: DataFrame, score: str, pixel_area: float | None, min_pixels: int = 1, most: int = 200, scene: str = "scene_id") -> DataFrame:
    """One row for each component: pixel_area, area_m2, bounding box, centroid and mean score.

    The ``most`` largest of each scene, ties by label; ``more`` says whether others were left.
    """
    joined = labels.join(px.select(scene, "r", "c", F.col(score).alias("_score")), [scene, "r", "c"])
    boxes = joined.groupBy(scene, "label").agg(
        F.count("*").alias("pixel_area"),
        F.min("c").alias("c0"), F.min("r").alias("r0"), (F.max("c") + 1).alias("c1"), (F.max("r") + 1).alias("r1"),
        F.avg("c").alias("centroid_c"), F.avg("r").alias("centroid_r"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("_score"))).alias("score"),
    ).where(F.col("pixel_area") >= min_pixels)
    order = Window.partitionBy(scene).orderBy(F.col("pixel_area").desc(), "label")
    ranked = boxes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most + 1)
    ranked = ranked.withColumn("more", F.max("rank").over(Window.partitionBy(scene)) > most)
    area = (F.col("pixel_area") * F.lit(pixel_area).cast("double")).alias("area_m2")
    return ranked.where(F.col("rank") <= most).select("*", area)
