"""Reference systems: WGS84 degrees and UTM zones, pairs of footprints, and warping between grids.

Coordinates are expressions: the transverse Mercator series to the fourth order of the third
flattening, both ways, so any two zones meet by way of degrees. A warp buckets the wanted pixels by the tile of
the source that they fall in, so a pixel meets its four neighbours in one bounded group, whatever the grids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.functions.binding import bound
from pixelquarry.operators.geometry import FLATTENING, SCALE, SEMI_MAJOR, overlap, pair_strategy
from pixelquarry.operators.staging import staged

#: Geographic degrees, and the hundreds of UTM codes north and south (fixed values).
WGS84, UTM_NORTH, UTM_SOUTH = 4326, 326, 327
FALSE_EASTING, FALSE_NORTHING = 500_000.0, 10_000_000.0
#: Edge in pixels of a source tile.
TILE = 64
SIDES = ("minx", "miny", "maxx", "maxy")
#: Metres of a degree, roughly: a cell of degrees is as many metres of a zone.
DEGREE = math.radians(SEMI_MAJOR)
#: Cells in a coarse one, by which scenes find the systems around them.
COARSE = 16

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))


def _series(*rows: tuple[float, ...]) -> tuple[float, ...]:
    """Coefficients from the factors of rising powers of n, of which row j starts at the j-th."""
    return tuple(sum(x * _N ** (j + i) for i, x in enumerate(row)) for j, row in enumerate(rows, 1))


# Factors of the series: ellipsoid to plane, plane to ellipsoid, conformal to geographic latitude (fixed values).
FORWARD = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
INVERSE = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
LATITUDE = _series((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def _degrees(easting: Column, northing: Column, zone: Column, north: Column) -> Column:
    """lon and lat in degrees, as a struct."""

    def bent(v: Column) -> Column:
        up, right = v["xi"], v["eta"]
        for k, b in enumerate(INVERSE, 1):
            up = up - b * F.sin(2 * k * v["xi"]) * F.cosh(2 * k * v["eta"])
            right = right - b * F.cos(2 * k * v["xi"]) * F.sinh(2 * k * v["eta"])
        return bound(conformal, up=up, right=right, zone=v["zone"])

    def conformal(v: Column) -> Column:
        lon = F.degrees(F.atan2(F.sinh(v["right"]), F.cos(v["up"]))) + (v["zone"] * 6 - 183)
        return bound(geographic, chi=F.asin(F.sin(v["up"]) / F.cosh(v["right"])), lon=lon)

    def geographic(v: Column) -> Column:
        lat = v["chi"]
        for k, d in enumerate(LATITUDE, 1):
            lat = lat + d * F.sin(2 * k * v["chi"])
        return F.struct(v["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    xi = (northing - F.when(north, 0.0).otherwise(FALSE_NORTHING)) / (SCALE * _RADIUS)
    return bound(bent, xi=xi, eta=(easting - FALSE_EASTING) / (SCALE * _RADIUS), zone=zone)


def _metres(lon: Column, lat: Column, zone: Column, north: Column) -> Column:
    """x and y in metres of a zone, as a struct."""

    def turned(v: Column) -> Column:
        t = F.sinh(F.atanh(v["sine"]) - ECCENTRICITY * F.atanh(ECCENTRICITY * v["sine"]))
        return bound(placed, t=t, away=v["away"], base=v["base"])

    def placed(v: Column) -> Column:
        right = F.atanh(F.sin(v["away"]) / F.sqrt(1 + v["t"] * v["t"]))
        return bound(bent, up=F.atan2(v["t"], F.cos(v["away"])), right=right, base=v["base"])

    def bent(v: Column) -> Column:
        y, x = v["up"], v["right"]
        for k, a in enumerate(FORWARD, 1):
            y = y + a * F.sin(2 * k * v["up"]) * F.cosh(2 * k * v["right"])
            x = x + a * F.cos(2 * k * v["up"]) * F.sinh(2 * k * v["right"])
        return F.struct((x * (SCALE * _RADIUS) + FALSE_EASTING).alias("x"), (y * (SCALE * _RADIUS) + v["base"]).alias("y"))

    base = F.when(north, 0.0).otherwise(FALSE_NORTHING)
    return bound(turned, sine=F.sin(F.radians(lat)), away=F.radians(lon - (zone * 6 - 183)), base=base)


def utm_to_wgs84(easting: Column, northing: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    found = _degrees(easting, northing, zone, north)
    return found["lon"], found["lat"]


def wgs84_to_utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of the zone that is named, wherever the point lies."""
    found = _metres(lon, lat, zone, north)
    return found["x"], found["y"]


def is_utm(epsg: Column) -> Column:
    return F.floor(epsg / 100).isin(UTM_NORTH, UTM_SOUTH) & (epsg % 100).between(1, 60)


def supported(epsg: Column) -> Column:
    """Whether coordinates of a code can be worked with: degrees or a UTM zone."""
    return F.coalesce(is_utm(epsg) | (epsg == WGS84), F.lit(False))


def utm_code(lon: Column, lat: Column) -> Column:
    """The code of the zone that a point of degrees lies in."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)
    return (F.when(lat >= 0, UTM_NORTH).otherwise(UTM_SOUTH) * 100 + zone).cast("int")


def _zone(epsg: Column) -> tuple[Column, Column]:
    return epsg % 100, F.floor(epsg / 100) == UTM_NORTH


def degrees(x: Column, y: Column, epsg: Column) -> Column:
    """lon and lat of a point of a system, as a struct; null where the code isn't supported."""
    given = F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    return F.when(is_utm(epsg), _degrees(x, y, *_zone(epsg))).when(epsg == WGS84, given)


def reprojected(x: Column, y: Column, source: Column, target: Column) -> Column:
    """x and y of another system, as a struct, by way of degrees; as they are in the same one, null where a
    code isn't supported."""

    def arrived(v: Column) -> Column:
        there = _metres(v["d"]["lon"], v["d"]["lat"], *_zone(v["target"]))
        here = F.struct(v["d"]["lon"].alias("x"), v["d"]["lat"].alias("y"))
        return F.when(is_utm(v["target"]), there).when(v["target"] == WGS84, here)

    same = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    found = F.when(source == target, same).otherwise(bound(arrived, d=degrees(x, y, source), target=target))
    return F.when(supported(source) & supported(target), found)


def reprojected_box(box: list[Column], source: Column, target: Column) -> Column:
    """minx, miny, maxx, maxy of the other system's box that holds a box's four corners, as a struct."""
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x in (box[0], box[2]) for y in (box[1], box[3])])

    def around(v: Column) -> Column:
        ends = {f + n: g(F.transform(v["p"], lambda p: p[n])) for n in "xy" for f, g in (("min", F.array_min), ("max", F.array_max))}
        return F.struct(*[ends[n].alias(n) for n in ("minx", "miny", "maxx", "maxy")])

    there = F.transform(corners, lambda p: reprojected(p["x"], p["y"], source, target))
    return F.when(supported(source) & supported(target), bound(around, p=there))


def _near(scenes: DataFrame, cell: float) -> DataFrame:
    """``scenes`` with a row for each system that scenes around one are of: its code and their box there, as _system and _of.

    Around is by a coarse grid of degrees, on which a scene covers its box and, beyond it, as far as its diagonal
    reaches: the box of its corners in any system lies within. So no scene is brought to a system far away.
    """
    around = reprojected_box([F.col(n) for n in SIDES], F.col("epsg"), F.lit(WGS84))
    d = {n: F.col("_d")[n] for n in SIDES}
    slant = F.greatest(F.lit(0.01), F.cos(F.radians(F.greatest(F.abs(d["miny"]), F.abs(d["maxy"])))))
    wide, high = d["maxx"] - d["minx"], d["maxy"] - d["miny"]
    reach = {"x": wide + high / slant, "y": wide + high}
    coarse = lambda v: F.floor(v / (COARSE * cell))
    ends = [x for n in "xy" for x in (coarse(d["min" + n] - reach[n]).alias(n + "0"), coarse(d["max" + n] + reach[n]).alias(n + "1"))]
    # Dealt out, as a table of few bytes is one task's, and bringing its boxes over takes long.
    placed = scenes.where(supported(F.col("epsg"))).select("scene_id", "epsg", *SIDES).repartition("scene_id")
    placed = placed.select("*", around.alias("_d"))
    placed = staged(placed.select("scene_id", "epsg", *SIDES, F.struct(*ends).alias("_range")))
    box = [f(n).alias(n) for n, f in zip(SIDES, (F.min, F.min, F.max, F.max))]
    cells = placed.groupBy("_range", "epsg").agg(*box)
    for n in "xy":
        cells = cells.withColumn("g" + n, F.explode(F.sequence(F.col("_range")[n + "0"], F.col("_range")[n + "1"])))
    there = cells.groupBy("gx", "gy", F.col("epsg").alias("_system")).agg(*box)
    near = cells.select("_range", "gx", "gy").distinct().join(there, ["gx", "gy"]).groupBy("_range", "_system").agg(F.struct(*box).alias("_of"))
    return placed.join(near, "_range").drop("_range")


def footprint_pairs(scenes: DataFrame, cell: float) -> DataFrame:
    """left, right, overlap, strategy of scenes (scene_id, epsg, minx, miny, maxx, maxy) that share ground.

    The overlap is taken in the left scene's system, the right one's four corners brought there, over the
    smaller box; ``strategy`` is how the right one comes on the left one's grid system. Scenes meet by the cells
    of a grid of the left one's system that their boxes there cover; a scene covers few cells if ``cell`` is about
    a scene's size in degrees. In each direction one scene of a pair begins in the cell of their shared corner, so
    only cells of such kinds are joined, and a pair comes up once. Scenes of unsupported systems meet none. Boxes
    stay on one side of the date line.
    """
    # Finer cells cost more rows a scene, but fewer pairs that share a cell and no ground.
    step = F.when(F.col("_system") == WGS84, cell / 2).otherwise(cell / 2 * DEGREE)
    begins = lambda n: (F.floor(F.col("_b")["min" + n] / step) == F.col("c" + n)).cast("int")

    def covering(rows: DataFrame) -> DataFrame:
        """A row for each cell that a box, _b, shares with the box of the system's scenes."""
        for n in "xy":
            lo = F.floor(F.greatest(F.col("_b")["min" + n], F.col("_of")["min" + n]) / step)
            hi = F.floor(F.least(F.col("_b")["max" + n], F.col("_of")["max" + n]) / step)
            rows = rows.withColumn("c" + n, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        return rows

    near = _near(scenes, cell)
    there = reprojected_box([F.col(n) for n in SIDES], F.col("epsg"), F.col("_system"))
    left = covering(near.where("epsg = _system").withColumn("_b", F.struct(*SIDES)))
    right = covering(near.withColumn("_b", there))
    # 0 to 3: whether a box begins in the cell by y (1) and by x (2); the left one's meets those that begin where it doesn't.
    right = right.withColumn("_kind", begins("x") * 2 + begins("y"))
    others = [F.array(*map(F.lit, kinds)) for kinds in ((3,), (2, 3), (1, 3), (0, 1, 2, 3))]
    left = left.withColumn("_kind", F.explode(F.element_at(F.array(*others), begins("x") * 2 + begins("y") + 1)))
    keys = ["_system", "cx", "cy", "_kind"]
    left, right = (df.select(*keys, *[F.col(n).alias(n + k) for n in ("scene_id", "epsg")], *[F.col("_b")[n].alias(n + k) for n in SIDES]) for df, k in ((left, "1"), (right, "2")))
    # A merge, as Spark would guess the sizes by the scenes' and broadcast all their cells.
    pairs = left.hint("merge").join(right, keys).where("scene_id1 < scene_id2")
    share = overlap(*[[F.col(n + k) for n in SIDES] for k in "12"])
    same = F.col("epsg1") == F.col("epsg2")
    grid = same & (F.col("minx1") == F.col("minx2")) & (F.col("miny1") == F.col("miny2")) & (F.col("maxx1") == F.col("maxx2")) & (F.col("maxy1") == F.col("maxy2"))
    rows = pairs.select(F.col("scene_id1").alias("left"), F.col("scene_id2").alias("right"), share.alias("overlap"), same.alias("_same"), grid.alias("_grid")).where("overlap > 0")
    return rows.select("left", "right", "overlap", pair_strategy(F.lit(True), F.col("overlap"), F.col("_same"), F.col("_grid")).alias("strategy"))


# --- warping --------------------------------------------------------------------------------


def pixel_of(x: Column, y: Column, affine: Column) -> tuple[Column, Column]:
    """Column and row, with parts, of a point on a grid with affine a, b, c, d, e, f (rotated ones, too); a
    pixel's centre has whole numbers."""
    a, b, c, d, e, f = (F.element_at(affine, k) for k in range(1, 7))
    whole = a * e - b * d
    return (e * (x - c) - b * (y - f)) / whole - 0.5, (a * (y - f) - d * (x - c)) / whole - 0.5


def centre_of(column: Column, row: Column, affine: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = (F.element_at(affine, k) for k in range(1, 7))
    return a * (column + 0.5) + b * (row + 0.5) + c, d * (column + 0.5) + e * (row + 0.5) + f


def _between(source: pa.Table, wanted: pa.Table, keys: list[str], bands: list[str], nearest: bool) -> pa.Table:
    """The bands at the wanted places of one tile, whose pixels lie in a square of TILE + 1."""
    y, x = (wanted.column(n).to_numpy() for n in ("_y", "_x"))
    r0, c0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    top, left = r0 // TILE * TILE, c0 // TILE * TILE
    fr, fc = y - r0, x - c0
    if nearest:
        r0, c0 = r0 + (fr >= 0.5), c0 + (fc >= 0.5)
        fr, fc = np.zeros_like(fr), np.zeros_like(fc)
    r0, c0 = r0 - top, c0 - left
    columns = [wanted.column(n) for n in (*keys, "r", "c")]
    for band in bands:
        plane = np.full((TILE + 2, TILE + 2), np.nan)
        if source.num_rows and wanted.num_rows:
            rows, cols = (source.column(n).to_numpy() for n in ("_pr", "_pc"))
            plane[rows - top[0], cols - left[0]] = source.column(band).cast(pa.float64()).to_numpy()
        row = lambda r: (1 - fc) * plane[r, c0] + np.where(fc > 0, fc * plane[r, c0 + 1], 0.0)
        value = (1 - fr) * row(r0) + np.where(fr > 0, fr * row(r0 + 1), 0.0)
        columns.append(pa.array(value, mask=np.isnan(value)))
    return pa.table(columns, names=[*keys, "r", "c", *bands])


def warped(
    px: DataFrame, grid: DataFrame, bands: list[str], affine: Column, target: Column,
    by: list[str] = ["scene_id"], source_epsg: Column | None = None, target_epsg: Column | None = None, nearest: bool = False,
) -> DataFrame:
    """``bands`` of ``px`` on another grid: by, r, c and the bands, by linear weights or the ``nearest`` pixel.

    ``grid`` has by, r, c of the wanted pixels and the columns that ``affine`` and ``source_epsg`` (of
    ``px``'s grid), ``target`` and ``target_epsg`` (of its own) are made of; without codes both are of one
    system. A wanted pixel's centre is found in the source, and its four neighbours there weigh; one
    that counts and is invalid or missing makes it null. A pixel on a tile's first row or column goes to the
    tile before, too. A group is a source tile and the wanted pixels in it: as many as the finer grid
    has on TILE by TILE pixels of the coarser.
    """
    x, y = centre_of(F.col("c"), F.col("r"), target)
    point = F.struct(x.alias("x"), y.alias("y")) if source_epsg is None else reprojected(x, y, target_epsg, source_epsg)
    grid = grid.withColumn("_p", point)
    at_c, at_r = pixel_of(F.col("_p.x"), F.col("_p.y"), affine)
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}
    keys = [*by, "_tr", "_tc"]
    tile = lambda v: F.floor(v / F.lit(float(TILE))).cast("int")
    wanted = grid.select(*by, "r", "c", at_r.alias("_y"), at_c.alias("_x"))
    wanted = wanted.withColumns({"_tr": tile(F.floor("_y")), "_tc": tile(F.floor("_x"))})
    lost = wanted.where("_y IS NULL OR _x IS NULL")
    wanted = wanted.where("_y IS NOT NULL AND _x IS NOT NULL")

    def tiles(n: str) -> Column:
        own = tile(F.col(n))
        return F.explode(F.when(F.pmod(F.col(n), F.lit(TILE)) == 0, F.array(own, own - 1)).otherwise(F.array(own)))

    # Under names of their own, as the wanted grid may be made of the same table.
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    source = px.select(*own, F.col("r").cast("int").alias("_pr"), F.col("c").cast("int").alias("_pc"), *[F.col(b).alias(b) for b in bands])
    source = source.withColumn("_sr", tiles("_pr")).withColumn("_sc", tiles("_pc"))
    source_keys = [*[f"_k{i}" for i in range(len(by))], "_sr", "_sc"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", r int, c int, " + ", ".join(f"`{b}` double" for b in bands)
    wanted = wanted.withColumns({"r": F.col("r").cast("int"), "c": F.col("c").cast("int")})

    def run(pixels: pa.Table, asked: pa.Table) -> pa.Table:
        return _between(pixels, asked, by, bands, nearest)

    found = source.groupBy(*source_keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, schema)
    none = lost.select(*by, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[F.lit(None).cast("double").alias(b) for b in bands])
    return found.unionByName(none)


__all__ = ["TILE", "degrees", "footprint_pairs", "reprojected", "reprojected_box", "supported", "utm_code", "utm_to_wgs84", "warped", "wgs84_to_utm"]
