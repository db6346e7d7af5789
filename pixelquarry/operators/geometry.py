"""Scene geometry: grids, footprints, pairs, areas and projected coordinates, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
#: WGS84 ellipsoid and the transverse Mercator scale (fixed values).
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
MEAN_RADIUS = 6371008.8
MIN_OVERLAP, FULL_OVERLAP = 0.30, 0.98


def pixel_size(t: list[Column]) -> tuple[Column, Column]:
    """Width and height of a pixel from the affine (a, b, c, d, e, f)."""
    return F.hypot(t[0], t[3]), F.hypot(t[1], t[4])


def is_georeferenced(epsg: Column, t: list[Column]) -> Column:
    same = F.lit(True)
    for x, y in zip(t, IDENTITY):
        same = same & (x == y)
    return epsg.isNotNull() & ~same


def is_north_up(epsg: Column, t: list[Column]) -> Column:
    return is_georeferenced(epsg, t) & (t[1] == 0) & (t[3] == 0) & (t[4] < 0)


def pixel_area(epsg: Column, t: list[Column], unit: Column) -> Column:
    """Square metres of a pixel on a projected grid; null unless georeferenced."""
    w, h = pixel_size(t)
    return F.when(is_georeferenced(epsg, t), w * h * unit * unit)


def pixels_for_area(area: Column, pixel: Column, default: int, frame: Column) -> Column:
    """Pixels that cover ``area``: 1 at least, a quarter of the frame at most."""
    wanted = F.when(pixel.isNotNull(), F.greatest(F.lit(1.0), F.bround(area / pixel, 0)))
    return F.least(F.coalesce(wanted, F.lit(float(default))), F.greatest(F.lit(1.0), F.floor(frame * 0.25))).cast("long")


def decimated(width: Column, height: Column, edge: int) -> tuple[Column, Column, Column]:
    """factor, width and height after decimation to ``edge``; half rounds to even."""
    longest = F.greatest(width, height)
    factor = F.when((F.lit(edge) <= 0) | (longest <= edge), 1.0).otherwise(longest / F.lit(float(max(1, edge))))
    return factor, *(F.greatest(F.lit(1), F.bround(x / factor, 0).cast("int")) for x in (width, height))


def to_geo(t: list[Column], c: Column, r: Column) -> tuple[Column, Column]:
    return t[0] * c + t[1] * r + t[2], t[3] * c + t[4] * r + t[5]


def bbox_to_geo(t: list[Column], c0: Column, r0: Column, c1: Column, r1: Column) -> list[Column]:
    """minx, miny, maxx and maxy of a pixel box, over its four corners."""
    corners = [to_geo(t, c, r) for c in (c0, c1) for r in (r0, r1)]
    xs, ys = zip(*corners)
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Shared area of two boxes over the smaller one; 0 if they are apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    smaller = F.least(*[(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)])
    return F.when((w > 0) & (h > 0), F.try_divide(w * h, smaller)).otherwise(0.0)


def pair_strategy(both_georeferenced: Column, share: Column, same_crs: Column, same_grid: Column) -> Column:
    """How two scenes are brought on one grid; too little overlap is incompatible."""
    out = F.when(~both_georeferenced | share.isNull(), "pixel_assume").when(share < MIN_OVERLAP, "incompatible")
    return out.when(~same_crs, "reproject").when(same_grid, "identical_grid").otherwise("resample")


def pair_warning(both_georeferenced: Column, share: Column) -> Column:
    """What a pair that can be compared is to be warned of."""
    out = F.when(~both_georeferenced, "not_georeferenced")
    return out.when((share >= MIN_OVERLAP) & (share < FULL_OVERLAP), "partial_overlap")


def ring_area(ring: Column) -> Column:
    """Square metres of a ring of (lon, lat) in degrees on the sphere of the earth's mean radius; the
    ring's order and closing don't matter, and rings stay on one side of the date line."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    step = lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"])))
    total = F.aggregate(F.zip_with(ring, following, step), F.lit(0.0), lambda s, x: s + x)
    return F.abs(total) * MEAN_RADIUS**2 / 2


def overlapping(scenes: DataFrame, cell: float) -> DataFrame:
    """left, right, overlap of scenes (scene_id, minx, miny, maxx, maxy) that share ground.

    Scenes meet by the cells of a coarse grid that they cover, and the pair is kept in the cell of
    its shared corner alone; a scene covers few cells if ``cell`` is about a scene's size.
    """
    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))

    placed = scenes.withColumn("cx", span("minx", "maxx")).withColumn("cy", span("miny", "maxy"))
    names = ["scene_id", "minx", "miny", "maxx", "maxy"]
    left, right = (placed.select("cx", "cy", *[F.col(n).alias(n + s) for n in names]) for s in ("1", "2"))
    pairs = left.join(right, ["cx", "cy"]).where("scene_id1 < scene_id2")
    share = overlap(*[[F.col(n + s) for n in names[1:]] for s in ("1", "2")])
    corner = (F.floor(F.greatest("minx1", "minx2") / cell) == F.col("cx")) & (F.floor(F.greatest("miny1", "miny2") / cell) == F.col("cy"))
    return pairs.where(corner).select(F.col("scene_id1").alias("left"), F.col("scene_id2").alias("right"), share.alias("overlap")).where("overlap > 0")


def geodesic_cell_area(lat: Column, dlon: float, dlat: float) -> Column:
    """Square metres of a cell of degrees around a latitude, by the ellipsoid's zone areas."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def zone(phi: Column) -> Column:
        s = F.sin(phi)
        return s / (2 * (1 - e2 * s * s)) + F.log((1 + e * s) / (1 - e * s)) / (4 * e)

    half = math.radians(dlat) / 2
    b = SEMI_MAJOR * (1 - FLATTENING)
    return b * b * math.radians(dlon) * (zone(F.radians(lat) + half) - zone(F.radians(lat) - half))
