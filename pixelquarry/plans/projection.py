"""Queries on reference systems: points and boxes of other systems, footprints of two, warps between grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.operators import geometry, neighbourhood, projection, rings
from pixelquarry.operators.staging import staged
from pixelquarry.plans import scenes as scenes_plan
from pixelquarry.plans import sql
from pixelquarry.plans.records import _SC, scenes
from pixelquarry.sources.scenes import pixel_grid, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_K = projection.SCALE * projection._RADIUS


def _sum(first: str, factors: tuple[float, ...], sign: str, term: str) -> str:
    return first + "".join(f" {sign} ({c!r}::DOUBLE)*{term.format(2 * k)}" for k, c in enumerate(factors, 1))


def degrees_sql(name: str, source: str, x: str = "x", y: str = "y", zone: str = "zone", north: str = "TRUE") -> str:
    """CTEs that add lon and lat to ``source``, which has a point of a zone; the last one is called ``name``."""
    up = _sum("xi", projection.INVERSE, "-", "sin({0}*xi)*cosh({0}*eta)")
    right = _sum("eta", projection.INVERSE, "-", "cos({0}*xi)*sinh({0}*eta)")
    lat = _sum("chi", projection.LATITUDE, "+", "sin({0}*chi)")
    return f"""{name}_a AS (SELECT *, (({y}) - CASE WHEN {north} THEN 0.0 ELSE 10000000.0 END)::DOUBLE/{_K!r}::DOUBLE AS xi, (({x}) - 500000.0)::DOUBLE/{_K!r}::DOUBLE AS eta FROM {source}),
{name}_b AS (SELECT *, {up} AS up, {right} AS rt FROM {name}_a),
{name}_c AS (SELECT *, asin(sin(up)/cosh(rt)) AS chi, degrees(atan2(sinh(rt), cos(up))) + ({zone}*6 - 183) AS lon FROM {name}_b),
{name} AS (SELECT * EXCLUDE (xi, eta, up, rt, chi), degrees({lat}) AS lat FROM {name}_c)"""


def zone_sql(name: str, source: str, zone: str, out: tuple[str, str] = ("ex", "ny"), north: str = "TRUE") -> str:
    """CTEs that add easting and northing of a zone to ``source``, which has lon and lat in degrees."""
    e = repr(projection.ECCENTRICITY)
    y = _sum("up", projection.FORWARD, "+", "sin({0}*up)*cosh({0}*rt)")
    x = _sum("rt", projection.FORWARD, "+", "cos({0}*up)*sinh({0}*rt)")
    return f"""{name}_a AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e}::DOUBLE*atanh({e}::DOUBLE*sin(radians(lat)))) AS tt, radians(lon - ({zone}*6 - 183)) AS away FROM {source}),
{name}_b AS (SELECT *, atan2(tt, cos(away)) AS up, atanh(sin(away)/sqrt(1 + tt*tt)) AS rt FROM {name}_a),
{name} AS (SELECT * EXCLUDE (tt, away, up, rt), ({x})*{_K!r}::DOUBLE + 500000.0 AS {out[0]}, ({y})*{_K!r}::DOUBLE + CASE WHEN {north} THEN 0.0 ELSE 10000000.0 END AS {out[1]} FROM {name}_b)"""


_E2 = geometry.FLATTENING * (2 - geometry.FLATTENING)
_BELOW = f"(sin({{0}})/(2*(1 - {_E2!r}::DOUBLE*sin({{0}})**2)) + ln((1 + {projection.ECCENTRICITY!r}::DOUBLE*sin({{0}}))/(1 - {projection.ECCENTRICITY!r}::DOUBLE*sin({{0}})))/(4*{projection.ECCENTRICITY!r}::DOUBLE))"
_HALF = "radians(0.001)/2"
_CELL = f"{geometry.SEMI_MAJOR * (1 - geometry.FLATTENING)!r}::DOUBLE**2*radians(0.001)*({_BELOW.format(f'radians(lat) + {_HALF}')} - {_BELOW.format(f'radians(lat) - {_HALF}')})"


@query("wgs84_centres", f"WITH {_SC}, p AS (SELECT scene_id, 700000 + minx*100 AS x, 2100000 + miny*100 AS y, 43 AS zone FROM sc), {degrees_sql('d', 'p')} SELECT scene_id, round(lon, 8) AS lon, round(lat, 8) AS lat, round({_CELL}, 2) AS cell_m2 FROM d")
def wgs84_centres(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = projection.utm_to_wgs84(700000 + F.col("minx") * 100, 2100000 + F.col("miny") * 100, F.lit(43), F.lit(True))
    rows = scenes(spark, sf).select("scene_id", lon.alias("lon"), lat.alias("lat"))
    cell = geometry.geodesic_cell_area(F.col("lat"), 0.001, 0.001)
    return rows.select("scene_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round(cell, 2).alias("cell_m2"))


_CORNERS = "p AS (SELECT scene_id, 43 AS zone, 700000 + unnest([minx, minx, maxx, maxx])*100 AS x, 2100000 + unnest([miny, maxy, miny, maxy])*100 AS y FROM sb)"


@query("wgs84_bounds", f"WITH {_SC}, {_CORNERS}, {degrees_sql('d', 'p')} SELECT scene_id, round(min(lon), 8) AS west, round(min(lat), 8) AS south, round(max(lon), 8) AS east, round(max(lat), 8) AS north FROM d GROUP BY scene_id")
def wgs84_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The box in degrees that holds a projected scene's four corners."""
    box = [700000 + F.col("minx") * 100, 2100000 + F.col("miny") * 100, 700000 + F.col("maxx") * 100, 2100000 + F.col("maxy") * 100]
    ends = projection.reprojected_box(box, F.lit(32643), F.lit(projection.WGS84))
    rows = scenes(spark, sf).select("scene_id", ends.alias("b"))
    names = {"west": "minx", "south": "miny", "east": "maxx", "north": "maxy"}
    return rows.select("scene_id", *[F.round(F.col("b")[x], 8).alias(n) for n, x in names.items()])


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """A point of degrees for each customer, on both halves of the earth."""
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(k.alias("point_id"), (k * 37 % 35989 / 100.0 - 179.9).alias("lon"), (k * 61 % 16001 / 100.0 - 80.0).alias("lat"))


_POINTS = "q AS (SELECT c_custkey AS point_id, c_custkey*37 % 35989/100.0::DOUBLE - 179.9::DOUBLE AS lon, c_custkey*61 % 16001/100.0::DOUBLE - 80.0::DOUBLE AS lat FROM customer), z AS (SELECT *, least(60, floor((lon + 180)/6) + 1)::INT AS zone FROM q)"


@query("utm_points", f"WITH {_POINTS}, {zone_sql('u', 'z', 'zone', north='lat >= 0')} SELECT point_id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone)::INT AS epsg, round(ex, 3) AS easting, round(ny, 3) AS northing FROM u")
def utm_points(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees in the zone that each point lies in."""
    rows = _points(spark, sf).withColumn("epsg", projection.utm_code(F.col("lon"), F.col("lat")))
    there = projection.reprojected(F.col("lon"), F.col("lat"), F.lit(projection.WGS84), F.col("epsg"))
    rows = rows.withColumn("p", there)
    return rows.select("point_id", "epsg", F.round("p.x", 3).alias("easting"), F.round("p.y", 3).alias("northing"))


@query("utm_between_zones", f"WITH {_SC}, p AS (SELECT scene_id, 800000 + minx*100 AS x, 2100000 + miny*100 AS y, 43 AS zone FROM sc), {degrees_sql('d', 'p')}, {zone_sql('u', 'd', '44')} SELECT scene_id, round(ex, 3) AS x44, round(ny, 3) AS y44, round(x, 3) AS x43, round(y, 3) AS y43 FROM u")
def utm_between_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Points of one zone in the next one, and back."""
    rows = scenes(spark, sf).select("scene_id", (800000 + F.col("minx") * 100).alias("x"), (2100000 + F.col("miny") * 100).alias("y"))
    rows = rows.withColumn("a", projection.reprojected(F.col("x"), F.col("y"), F.lit(32643), F.lit(32644)))
    rows = rows.withColumn("b", projection.reprojected(F.col("a.x"), F.col("a.y"), F.lit(32644), F.lit(32643)))
    return rows.select("scene_id", *[F.round(x, 3).alias(n) for n, x in (("x44", "a.x"), ("y44", "a.y"), ("x43", "b.x"), ("y43", "b.y"))])


#: How far east a place of zone 43 counts in zone 44 is about so many metres less.
_EAST = 631_000


def _two_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints of which every third is of the zone to the east, on the same ground."""
    k = F.col("scene_id")
    other = k % 3 == 1
    off = F.when(other, float(_EAST)).otherwise(0.0)
    rows = scenes(spark, sf)
    x = lambda n: 800000 + F.col(n) * 100 - off
    return rows.select("scene_id", F.when(other, 32644).otherwise(32643).alias("epsg"), x("minx").alias("minx"), (2100000 + F.col("miny") * 100).alias("miny"), x("maxx").alias("maxx"), (2100000 + F.col("maxy") * 100).alias("maxy"))


_TWO = f"""tz AS (SELECT scene_id, scene_id % 3 = 1 AS other, 800000 + minx*100 - CASE WHEN scene_id % 3 = 1 THEN {_EAST} ELSE 0 END AS minx, 2100000 + miny*100 AS miny,
  800000 + maxx*100 - CASE WHEN scene_id % 3 = 1 THEN {_EAST} ELSE 0 END AS maxx, 2100000 + maxy*100 AS maxy FROM sb)"""
_OTHER = f"""k AS (SELECT scene_id, other, CASE WHEN other THEN 44 ELSE 43 END AS zone, unnest([minx, minx, maxx, maxx]) AS x, unnest([miny, maxy, miny, maxy]) AS y FROM tz),
{degrees_sql('d', 'k')}, {zone_sql('u', 'd', 'CASE WHEN other THEN 43 ELSE 44 END')},
mv AS MATERIALIZED (SELECT scene_id, min(ex) AS minx, min(ny) AS miny, max(ex) AS maxx, max(ny) AS maxy FROM u GROUP BY scene_id)"""


@query("footprint_overlap_zones", f"""WITH {_SC}, {_TWO}, {_OTHER},
b AS (SELECT a.scene_id AS "left", s.scene_id AS "right", a.other = s.other AS same, a.minx, a.miny, a.maxx, a.maxy,
  CASE WHEN same THEN s.minx ELSE m.minx END AS x0, CASE WHEN same THEN s.miny ELSE m.miny END AS y0, CASE WHEN same THEN s.maxx ELSE m.maxx END AS x1, CASE WHEN same THEN s.maxy ELSE m.maxy END AS y1
  FROM tz a JOIN tz s ON a.scene_id < s.scene_id JOIN mv m ON m.scene_id = s.scene_id),
o AS (SELECT *, greatest(0, least(maxx, x1) - greatest(minx, x0))*greatest(0, least(maxy, y1) - greatest(miny, y0))/least((maxx - minx)*(maxy - miny), (x1 - x0)*(y1 - y0)) AS overlap FROM b)
SELECT "left", "right", round(overlap, 6) AS overlap, CASE WHEN overlap < 0.3 THEN 'incompatible' WHEN NOT same THEN 'reproject' WHEN minx = x0 AND miny = y0 AND maxx = x1 AND maxy = y1 THEN 'identical_grid' ELSE 'resample' END AS strategy FROM o WHERE overlap > 0""")
def footprint_overlap_zones(spark: SparkSession, sf: str) -> DataFrame:
    return projection.footprint_pairs(_two_zones(spark, sf), 0.04).withColumn("overlap", F.round("overlap", 6))


def _array(*v: float | Column) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v])


#: What a row of the wanted grid gets from four neighbours, in the order of the operator's sums.
def _four(band: str) -> str:
    row = lambda r: f"((1-fc)*max(CASE WHEN i = {r} AND j = 0 THEN {band} END) + CASE WHEN fc > 0 THEN fc*max(CASE WHEN i = {r} AND j = 1 THEN {band} END) ELSE 0 END)"
    return f"(1-fr)*{row(0)} + CASE WHEN fr > 0 THEN fr*{row(1)} ELSE 0 END"


_NEAR = """n AS (SELECT g.*, y - floor(y) AS fr, x - floor(x) AS fc, floor(y)::INT + i AS pr, floor(x)::INT + j AS pc, i, j FROM g, range(2) a(i), range(2) b(j)),
m AS (SELECT n.*, vv, nir FROM n LEFT JOIN p ON p.scene_id = n.scene_id AND p.r = pr AND p.c = pc)"""


@query("resample", f"""WITH p AS (SELECT scene_id, r, c, vv, nir FROM ({sql.PX})), g AS (SELECT scene_id, r, c, (10.0*((-15.0*(r+0.5) - 7.0) - 0.0))/-100.0::DOUBLE - 0.5 AS y, (-10.0*((15.0*(c+0.5) + 4.0) - 0.0))/-100.0::DOUBLE - 0.5 AS x FROM p WHERE r < 30 AND c < 80), {_NEAR}
SELECT scene_id, r, c, {_four('vv')} AS vv, {_four('nir')} AS nir FROM m GROUP BY scene_id, r, c, fr, fc""")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of ten-metre pixels on a grid of fifteen, a little off."""
    px = pixel_grid(spark, sf)
    grid = px.where("r < 30 AND c < 80").select("scene_id", "r", "c")
    return projection.warped(px, grid, ["vv", "nir"], _array(10, 0, 0, 0, -10, 0), _array(15, 0, 4, 0, -15, -7))


#: Scenes lie apart in zone 43, towards its east; the wanted grid is of zone 44 and of twelve metres.
_X0, _Y0, _STEP = 790_000, 2_100_000, 1_000


@query("warp_zones", f"""WITH p AS (SELECT scene_id, r, c, vv, nir FROM ({sql.PX})), w AS (SELECT scene_id, r, c, scene_id % 40 AS k FROM p WHERE r < 38 AND c < 100),
h AS (SELECT scene_id, k, {_X0 - _EAST + 700}::DOUBLE + k*{_STEP} AS x, {_Y0 + 2900}::DOUBLE AS y, 0 AS z FROM w GROUP BY ALL),
q AS (SELECT w.*, 44 AS zone, 12.0*(c+0.5) + ({_X0 - _EAST + 300}.0 + k*{_STEP}) AS x, -12.0*(r+0.5) + {_Y0 + 3000}.0 AS y FROM w), {degrees_sql('d', 'q')}, {zone_sql('u', 'd', '43')},
g AS (SELECT scene_id, r, c, (ny - {_Y0 + 3000}.0)/-10.0::DOUBLE - 0.5 AS y, (ex - ({_X0}.0 + k*{_STEP}))/10.0::DOUBLE - 0.5 AS x FROM u), {_NEAR}
SELECT scene_id, r, c, round({_four('vv')}, 4) AS vv, round({_four('nir')}, 4) AS nir FROM m GROUP BY scene_id, r, c, fr, fc""")
def warp_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of one zone on a grid of the next one; what lies outside is null."""
    px = pixel_grid(spark, sf)
    east = F.col("scene_id") % 40 * float(_STEP)
    grid = px.where("r < 38 AND c < 100").select("scene_id", "r", "c")
    source, target = _array(10, 0, _X0 + east, 0, -10, _Y0 + 3000), _array(12, 0, _X0 - _EAST + 300 + east, 0, -12, _Y0 + 3000)
    found = projection.warped(px, grid, ["vv", "nir"], source, target, source_epsg=F.lit(32643), target_epsg=F.lit(32644))
    return found.withColumns({b: F.round(b, 4) for b in ("vv", "nir")})


_E = repr(projection.ECCENTRICITY)
_S = "sin(radians({0}))"
_Q = f"(1 - {_E2!r}::DOUBLE)*({_S}/(1 - {_E2!r}::DOUBLE*{_S}**2) + ln((1 + {_E}::DOUBLE*{_S})/(1 - {_E}::DOUBLE*{_S}))/(2*{_E}::DOUBLE))"
_EDGE = f"radians(blon - lon)*({_Q.format('lat')} + 4*{_Q.format('((lat + blat)/2)')} + {_Q.format('blat')})/6"


@query("region_shapes", f"""{scenes_plan._COMPONENTS}, q AS (SELECT scene_id, label, r, c, unnest([0, 1, 1, 0]) AS j, unnest([0, 0, 1, 1]) AS i, unnest(range(4)) AS k FROM nb),
cq AS (SELECT *, 43 AS zone, 700000.0 + scene_id*2000 + 10.0*(c + j) AS x, 2100000.0 - 10.0*(r + i) AS y FROM q), {degrees_sql('d', 'cq')},
e AS (SELECT scene_id, label, r, c, lon, lat, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, first_value(lon) OVER w AS flon, first_value(lat) OVER w AS flat FROM d WINDOW w AS (PARTITION BY scene_id, r, c ORDER BY k)),
f AS (SELECT scene_id, label, r, c, lon, lat, coalesce(nlon, flon) AS blon, coalesce(nlat, flat) AS blat FROM e),
px AS (SELECT scene_id, label, r, c, abs(sum({_EDGE}))*{geometry.SEMI_MAJOR**2 / 2!r}::DOUBLE AS m2 FROM f GROUP BY ALL)
SELECT scene_id, label::INT AS label, count(*) AS pixel_area, round(sum(m2), 1) AS area_m2 FROM px GROUP BY ALL""")
def region_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as polygons with holes; their areas on the ellipsoid are those of their pixels."""
    labels = neighbourhood.components(staged(scenes_plan._mask(spark, sf)), "mask")
    affine = _array(10, 0, 700000 + F.col("scene_id") * 2000.0, 0, -10, 2100000)
    found = rings.region_shapes(rings.rings(labels), affine, F.lit(32643))
    return found.select("scene_id", "label", "pixel_area", F.round("area_m2", 1).alias("area_m2"))
