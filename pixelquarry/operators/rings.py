"""Regions as polygons with holes: rings along pixel edges, their areas, and the same rings on the ground.

A region is a group, bounded by its scene. Tracing finds directed unit edges with the region on their right
(rows grow downwards) and chains them; where two pixels touch by a corner alone a ring is cut, so none meets itself
and a region in one label may have several outer rings. Coordinates, areas and GeoJSON are expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.binding import bound
from pixelquarry.operators import projection
from pixelquarry.operators.geometry import SEMI_MAJOR
from pixelquarry.operators.neighbourhood import plane

_RINGS_DDL = "ring int, outer int, hole boolean, points array<struct<x:double,y:double>>"


def traced(mask: np.ndarray) -> list[np.ndarray]:
    """The rings of a mask as corners (column, row), each closed by its first; outer ones run clockwise as
    seen on the picture, holes the other way."""
    full = np.pad(mask, 1)
    inside, up, left = full[1:-1, 1:-1], full[:-2, 1:-1], full[1:-1, :-2]
    down, right = full[2:, 1:-1], full[1:-1, 2:]
    starts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    # Top edges run to the right, right ones down, bottom ones to the left, left ones up.
    for where, (c0, r0), step in ((inside & ~up, (0, 0), (1, 0)), (inside & ~right, (1, 0), (0, 1)), (inside & ~down, (1, 1), (-1, 0)), (inside & ~left, (0, 1), (0, -1))):
        for r, c in np.argwhere(where).tolist():
            starts.setdefault((c + c0, r + r0), []).append(step)
    rings = []
    while starts:
        first = min(starts)
        here, way = first, starts[first][0]
        corners = []
        while True:
            ways = starts[here]
            # At a corner that two pixels share, keep to the pixel that the ring comes from: turn right.
            turned = (-way[1], way[0])
            step = turned if corners and len(ways) > 1 and turned in ways else (ways[0] if not corners or len(ways) == 1 else way)
            ways.remove(step)
            if not ways:
                del starts[here]
            if not corners or step != way:
                corners.append(here)
            way, here = step, (here[0] + step[0], here[1] + step[1])
            if here == first and (here not in starts or (-way[1], way[0]) not in starts[here]):
                break
        rings += _simple(corners)
    return rings


def _simple(corners: list[tuple[int, int]]) -> list[np.ndarray]:
    """A ring cut where it passes a corner again: loops that meet at corners alone."""
    out, path, at = [], [], {}
    for corner in corners:
        if corner in at:
            start = at[corner]
            loop = path[start:]
            for passed in loop:
                del at[passed]
            del path[start:]
            out.append(np.array([*loop, loop[0]]))
        at[corner] = len(path)
        path.append(corner)
    return [*out, np.array([*path, path[0]])]


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a point that lies on no edge is inside."""
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    upright = (x0 == x1) & (x0 > x) & ((y0 > y) != (y1 > y))
    return bool(upright.sum() % 2)


def nested(rings: list[np.ndarray]) -> list[tuple[int, int, bool, np.ndarray]]:
    """number, its outer ring's number, whether it is a hole, and the corners; a hole belongs to the smallest outer
    ring around it."""
    areas = [signed_area(r) for r in rings]
    outers = sorted((k for k in range(len(rings)) if areas[k] > 0), key=lambda k: areas[k])
    number = {k: n for n, k in enumerate(sorted(outers, key=lambda k: (-areas[k], rings[k].tolist())), 1)}
    out = [(n, n, False, rings[k]) for k, n in number.items()]
    for k, ring in enumerate(rings):
        if areas[k] < 0:
            # Just inside the hole, next to its first corner: the way there runs along the region's edge.
            x, y = np.min(ring[:, 0]), np.min(ring[ring[:, 0] == np.min(ring[:, 0])][:, 1])
            owner = next(o for o in outers if areas[o] > -areas[k] and _holds(rings[o], x + 0.5, y + 0.5))
            out.append((len(out) + 1, number[owner], True, ring))
    return out


def rings(labels: DataFrame, by: list[str] = ["scene_id"]) -> DataFrame:
    """by, label, ring, outer, hole, points: the rings of each region of ``labels`` (by, r, c, label).

    Points are pixel corners (x to the right, y down), closed by the first one, without those on a straight line.
    ``outer`` is the number of the ring that holds a hole, or of itself; the areas of a region's outer rings less its
    holes are its pixels.
    """
    keys = [*by, "label"]
    kinds = {f.name: f.dataType.simpleString() for f in labels.schema}
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(table: pa.Table) -> pa.Table:
        r0, c0 = (min(table.column(n).to_pylist()) for n in ("r", "c"))
        own = pa.table({"r": pa.array(table.column("r").to_numpy() - r0), "c": pa.array(table.column("c").to_numpy() - c0), "m": pa.array(np.ones(table.num_rows, dtype=bool))})
        found = nested(traced(plane(own, "m", False)))
        points = [[{"x": float(x + c0), "y": float(y + r0)} for x, y in ring.tolist()] for *_, ring in found]
        same = [pa.chunked_array([pa.concat_arrays([table.column(k).slice(0, 1).combine_chunks()] * len(found))]) for k in keys]
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
        return pa.table([*same, *columns, pa.array(points, point)], names=[*keys, "ring", "outer", "hole", "points"])

    return labels.groupBy(*keys).applyInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _RINGS_DDL)


def _summed(points: Column, step) -> Column:
    """The sum of ``step`` over the edges of a closed ring."""
    edges = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), step)
    return F.aggregate(edges, F.lit(0.0), lambda s, x: s + x)


def plane_area(points: Column) -> Column:
    """The area of a closed ring in the square of its own units."""
    return F.abs(_summed(points, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def _below(lat: Column) -> Column:
    """What the ellipsoid has between the equator and a latitude, a radian wide, over half its squared axis: the
    authalic integral."""
    e = projection.ECCENTRICITY
    s = F.sin(F.radians(lat))
    return (1 - e * e) * (s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))


def ellipsoid_area(points: Column) -> Column:
    """Square metres of a closed ring of degrees (x: longitude, y: latitude) on the ellipsoid.

    Edges are straight in degrees; each one's integral is taken by Simpson's rule. Rings stay on one side
    of the date line.
    """
    mean = lambda a, b: (_below(a["y"]) + 4 * _below((a["y"] + b["y"]) / 2) + _below(b["y"])) / 6
    return F.abs(_summed(points, lambda a, b: F.radians(b["x"] - a["x"]) * mean(a, b))) * (SEMI_MAJOR**2 / 2)


def on_ground(points: Column, affine: Column) -> Column:
    """Rings of pixel corners by a grid's affine a, b, c, d, e, f."""
    a, b, c, d, e, f = (F.element_at(affine, k) for k in range(1, 7))
    return F.transform(points, lambda p: F.struct((a * p["x"] + b * p["y"] + c).alias("x"), (d * p["x"] + e * p["y"] + f).alias("y")))


def in_degrees(points: Column, epsg: Column) -> Column:
    """Rings of a system in degrees; null where its code isn't supported."""
    moved = F.transform(points, lambda p: projection.reprojected(p["x"], p["y"], epsg, F.lit(projection.WGS84)))
    return F.when(projection.supported(epsg), moved)


def region_shapes(rings: DataFrame, affine: Column, epsg: Column, by: list[str] = ["scene_id"]) -> DataFrame:
    """by, label, holes, pixel_area, area_m2 (on the ellipsoid; null without a supported system) and geojson, a
    MultiPolygon in degrees, or in pixels where no system is known.

    ``affine`` and ``epsg`` are expressions over ``rings``. Outer rings run against the clock, holes with it, as
    GeoJSON wants them on the ground.
    """
    rows = rings.withColumn("_ground", in_degrees(on_ground(F.col("points"), affine), epsg))
    sign = F.when(F.col("hole"), -1.0).otherwise(1.0)
    # Pixel rings run with the clock on the picture, whose rows grow downwards: on the ground, whose north is up, too.
    shown = F.transform(F.reverse(F.coalesce("_ground", "points")), lambda p: F.array(p["x"], p["y"]))
    per = rows.groupBy(*by, "label", "outer").agg(
        F.sum(sign * plane_area(F.col("points"))).alias("_px"), F.sum(sign * ellipsoid_area(F.col("_ground"))).alias("_m2"),
        F.count_if("hole").alias("_holes"), F.sort_array(F.collect_list(F.struct("hole", "ring", shown.alias("p")))).alias("_rings"),
    )
    shapes = F.sort_array(F.collect_list(F.struct("outer", F.transform("_rings", lambda r: r["p"]).alias("p"))))
    whole = per.groupBy(*by, "label").agg(F.sum("_holes").alias("holes"), F.round(F.sum("_px")).cast("long").alias("pixel_area"), F.sum("_m2").alias("area_m2"), shapes.alias("_s"))
    geometry = bound(lambda v: F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), v["c"].alias("coordinates"))), c=F.transform("_s", lambda s: s["p"]))
    return whole.withColumn("geojson", geometry).drop("_s")


__all__ = ["ellipsoid_area", "in_degrees", "nested", "on_ground", "plane_area", "region_shapes", "rings", "signed_area", "traced"]
