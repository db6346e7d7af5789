"""Texture, edges, lines and shapes: kernels that need a scene, or a region, at once.

A scene is one group, bounded by the reader's edge limit; percentiles and box means around a kernel
are DataFrame operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators.neighbourhood import box_mean, dilate, erode, label, per_scene, plane
from pixelquarry.operators.thresholds import fill_invalid, stretch

#: Percentile of the gradient that gives the upper edge threshold, its bounds, and the lower one's part.
EDGE_PERCENTILE, EDGE_BOUNDS, EDGE_LOWER = 96.0, (30.0, 200.0), 0.4
#: Smoothing before the gradient's percentile is taken: pixels either side and deviation.
BLUR, SIGMA = 2, 1.4
#: Directions of line elements, in degrees.
LINES = (0, 30, 60, 90, 120, 150)


def _prepared(px: DataFrame, band: str, by: list[str], out: str) -> DataFrame:
    """``px`` with ``out``: the band without gaps, stretched to [0, 1]."""
    filled = fill_invalid(px.withColumn(out, F.col(band)), out, by)
    return stretch(filled, out, by, 0.01, 0.99, out)


def local_deviation(px: DataFrame, band: str, out: str, window: int = 7, scene: str = "scene_id") -> DataFrame:
    """``px`` with ``out``: the local standard deviation of the stretched band, stretched again.

    Invalid pixels count as the median; borders reflect.
    """
    rows = _prepared(px, band, [scene], "_x").withColumn("_xx", F.col("_x") * F.col("_x"))
    means = box_mean(rows, ["_x", "_xx"], window, "reflect", scene)
    spread = means.select(scene, "r", "c", F.sqrt(F.greatest(F.col("_xx") - F.col("_x") * F.col("_x"), F.lit(0.0))).alias(out))
    return px.drop(out).join(stretch(spread, out, [scene], 0.01, 0.99, out), [scene, "r", "c"])


def _reflected(x: np.ndarray, reach: int) -> np.ndarray:
    return np.pad(x, reach, mode="reflect" if min(x.shape) > reach else "symmetric")


def sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along columns and rows by the 3 by 3 Sobel kernels, borders reflecting."""
    p = _reflected(x.astype(np.float64), 1)
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def _blurred(x: np.ndarray) -> np.ndarray:
    weights = np.exp(-np.arange(-BLUR, BLUR + 1) ** 2 / (2 * SIGMA**2))
    weights /= weights.sum()
    p = _reflected(x.astype(np.float64), BLUR)
    rows = sum(w * p[k : k + x.shape[0]] for k, w in enumerate(weights))
    return np.rint(sum(w * rows[:, k : k + x.shape[1]] for k, w in enumerate(weights)))


def edges(image: np.ndarray) -> np.ndarray:
    """Edge pixels of an 8-bit image: thinned gradient maxima over the upper threshold, and those over
    the lower one that touch them."""
    high = float(np.clip(np.percentile(np.hypot(*sobel(_blurred(image))), EDGE_PERCENTILE), *EDGE_BOUNDS))
    low, high = int(high * EDGE_LOWER), int(high)
    gx, gy = sobel(image)
    size = np.abs(gx) + np.abs(gy)
    padded = np.pad(size, 1)
    h, w = size.shape
    at = lambda dr, dc: padded[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]
    steep, flat = np.abs(gy) > np.tan(np.pi * 3 / 8) * np.abs(gx), np.abs(gy) < np.tan(np.pi / 8) * np.abs(gx)
    rising = (gx < 0) == (gy < 0)
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(rising, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(rising, at(1, 1), at(1, -1))))
    # Along rows and columns the first of two equal maxima stays; on diagonals neither does.
    peak = (size > before) & np.where(flat | steep, size >= after, size > after)
    weak = peak & (size > low)
    numbers = label(weak)
    strong = np.zeros(int(numbers.max()) + 1, dtype=bool)
    strong[numbers[weak & (size > high)]] = True
    return strong[numbers] & weak


def edge_density(px: DataFrame, band: str, out: str, window: int = 9, scene: str = "scene_id") -> DataFrame:
    """``px`` with ``out``: the share of edge pixels around each pixel, stretched to [0, 1]."""
    rows = _prepared(px.select(scene, "r", "c", band), band, [scene], "_x")
    found = per_scene(rows, [scene], lambda t: {"_x": edges(np.floor(plane(t, "_x", 0.0) * 255)).astype(np.float64)}, {"_x": "double"})
    density = box_mean(found, ["_x"], window, "reflect", scene).withColumnRenamed("_x", out)
    return px.drop(out).join(stretch(density, out, [scene], 0.01, 0.99, out), [scene, "r", "c"])


def line_element(length: int, degrees: int) -> list[tuple[int, int]]:
    """Offsets (row, column) that lie within half a pixel of a line through the origin, and no farther along it
    than half of its length."""
    reach, angle = length // 2, np.deg2rad(degrees)
    row, column = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    across = np.abs(row * np.cos(angle) - column * np.sin(angle))
    along = np.abs(row * np.sin(angle) + column * np.cos(angle))
    near = (across <= 0.5 + 1e-9) & (along <= reach + 1e-9)
    return list(zip(row[near].tolist(), column[near].tolist()))


def _opened(image: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    """Grey opening: the least around each place, then the most of these."""
    reach = max(max(abs(a), abs(b)) for a, b in element)
    h, w = image.shape
    moved = lambda x, fill, sign: [np.pad(x, reach, constant_values=fill)[reach + sign * a : reach + sign * a + h, reach + sign * b : reach + sign * b + w] for a, b in element]
    return np.maximum.reduce(moved(np.minimum.reduce(moved(image, np.inf, 1)), -np.inf, -1))


def linear_structure(px: DataFrame, band: str, out: str, length: int = 25, scene: str = "scene_id") -> DataFrame:
    """``px`` with ``out``: the largest of the openings by line elements, stretched to [0, 1]."""
    rows = _prepared(px.select(scene, "r", "c", band), band, [scene], "_x")
    best = lambda image: np.maximum.reduce([_opened(image, line_element(length, d)) for d in LINES])
    found = per_scene(rows, [scene], lambda t: {"_x": best(np.floor(plane(t, "_x", 0.0) * 255))}, {"_x": "double"}).withColumnRenamed("_x", out)
    return px.drop(out).join(stretch(found.select(scene, "r", "c", out), out, [scene], 0.01, 0.99, out), [scene, "r", "c"])


#: Steps to the eight neighbours, in turn (clockwise from the right).
_TURN = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def outline(mask: np.ndarray) -> np.ndarray:
    """The outer border of the component that holds a mask's first pixel: (row, column) in order."""
    first = tuple(int(x) for x in np.argwhere(mask)[0])
    inside = lambda r, c: 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and bool(mask[r, c])
    out, here, back = [first], first, 4  # the pixel to the left of the first one is outside
    start = None
    while True:
        for k in range(1, 9):
            way = (back + k) % 8
            there = (here[0] + _TURN[way][0], here[1] + _TURN[way][1])
            if inside(*there):
                break
        else:
            return np.array(out)  # a single pixel
        if (here, there) == start:
            return np.array(out[:-1])
        start = start or (here, there)
        here, back = there, (way + 4) % 8
        out.append(here)


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed line without the points that lie within ``tolerance`` of the rest."""
    if len(points) < 4:
        return points
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    keep = np.zeros(len(points) + 1, dtype=bool)
    ring = np.vstack([points, points[:1]]).astype(np.float64)
    keep[[0, far, len(points)]] = True
    waiting = [(0, far), (far, len(points))]
    while waiting:
        a, b = waiting.pop()
        if b - a < 2:
            continue
        way, off = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = float(np.hypot(*way))
        distance = np.abs(way[0] * off[:, 1] - way[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        k = int(np.argmax(distance))
        if distance[k] > tolerance:
            keep[a + 1 + k] = True
            waiting += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep[:-1]]


def _shape(points: np.ndarray) -> tuple[float, float]:
    """Compactness of a border's polygon, and its share of its smallest rectangle."""
    x, y = points[:, 1].astype(np.float64), points[:, 0].astype(np.float64)
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    area, length = abs(float((x * ny - nx * y).sum())) / 2, float(np.hypot(nx - x, ny - y).sum())
    if area <= 4:
        return float("nan"), float("nan")
    angles = np.unique(np.arctan2(ny - y, nx - x) % (np.pi / 2))
    u, v = np.cos(angles)[:, None] * x + np.sin(angles)[:, None] * y, np.cos(angles)[:, None] * y - np.sin(angles)[:, None] * x
    least = float((np.ptp(u, axis=1) * np.ptp(v, axis=1)).min())
    return min(1.0, 4 * np.pi * area / length**2), min(1.0, area / least) if least > 1e-6 else float("nan")


def polygons(labels: DataFrame, tolerance: float = 1.5, by: list[str] = ["scene_id"]) -> DataFrame:
    """by, label, outline (row and column of each corner, simplified), compactness, rectangularity.

    One row a region of ``labels`` (by, r, c, label): a region is a group. Fewer than three corners
    give those of its box; shapes of four square pixels or less have no scores (null).
    """
    keys = [*by, "label"]
    kinds = {f.name: f.dataType.simpleString() for f in labels.schema}

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy() for x in ("r", "c"))
        grid = np.zeros((int(np.ptp(r)) + 1, int(np.ptp(c)) + 1), dtype=bool)
        grid[r - r.min(), c - c.min()] = True
        border = outline(grid)
        corners = simplified(border, tolerance)
        if len(corners) < 3:
            corners = np.array([[0, 0], [0, grid.shape[1]], [grid.shape[0], grid.shape[1]], [grid.shape[0], 0]])
        scores = _shape(border)
        found = [{"r": int(a + r.min()), "c": int(b + c.min())} for a, b in corners.tolist()]
        values = [found, *[None if s != s else s for s in scores]]
        kind = pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32())]))
        columns = [table.column(k).slice(0, 1) for k in keys] + [pa.array([v], t) for v, t in zip(values, (kind, pa.float64(), pa.float64()))]
        return pa.table(columns, names=[*keys, "outline", "compactness", "rectangularity"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", outline array<struct<r:int,c:int>>, compactness double, rectangularity double"
    return labels.groupBy(*keys).applyInArrow(run, schema)


__all__ = ["dilate", "edge_density", "edges", "erode", "line_element", "linear_structure", "local_deviation", "outline", "polygons", "simplified", "sobel"]
