"""Queries on pictures, kernels, other grids and registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions import spectral
from pixelquarry.operators import geometry, kernels, landcover, neighbourhood, pictures, radar, registration
from pixelquarry.operators.staging import staged
from pixelquarry.plans import scenes as scenes_plan
from pixelquarry.plans import sql
from pixelquarry.sources.scenes import BANDS, pixel_grid, pixel_pair

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _channel(x: str, k: int) -> str:
    stops = [float(s[k]) for s in pictures.HEAT]
    n = len(stops) - 1
    at = f"least(floor({x}*{n}), {n - 1})::INT"
    return f"floor(list_extract({stops}, {at} + 1) + (list_extract({stops}, {at} + 2) - list_extract({stops}, {at} + 1))*({x}*{n} - {at}) + 0.5)::INT"


_SCORED = f"sx AS (SELECT scene_id, r, c, nir, greatest(0, least(1, (({sql.INDICES['ndvi']})+1)/2))::DOUBLE AS x FROM ({sql.FIELDS}))"
_HEAT_SQL = "ht AS (SELECT scene_id, r, c, " + ", ".join(f"CASE WHEN nir IS NULL THEN 0 ELSE {_channel('x', k)} END AS {n}" for k, n in enumerate(("red8", "green8", "blue8"))) + " FROM sx)"


def _heat(spark: SparkSession, sf: str) -> DataFrame:
    px = landcover.with_indices(pixel_grid(spark, sf, fields=True), ["ndvi"])
    return pictures.heat_map(px.withColumn("score", spectral.score_map(F.col("ndvi"))), "score")


@query("heat_map", f"WITH {_SCORED}, {_HEAT_SQL} SELECT * FROM ht")
def heat_map(spark: SparkSession, sf: str) -> DataFrame:
    return _heat(spark, sf).select("scene_id", "r", "c", "red8", "green8", "blue8")


@query("legend", f"WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)} SELECT scene_id, class_code::INT AS class_code, CASE class_code " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in pictures.CLASS_COLOURS.items()) + " END AS colour, round(count(*)/sum(count(*)) OVER (PARTITION BY scene_id), 6) AS fraction FROM lc GROUP BY scene_id, class_code")
def legend(spark: SparkSession, sf: str) -> DataFrame:
    lc = landcover.classify(pixel_grid(spark, sf, fields=True), list(BANDS))
    return pictures.legend(lc).withColumn("fraction", F.round("fraction", 6))


_COLOUR = (250, 20, 200)
_OUTLINE = """nb AS (SELECT a.scene_id, a.r, a.c FROM mm a, (VALUES (0,1),(0,-1),(1,0),(-1,0)) o(dr, dc) JOIN mm b ON b.scene_id = a.scene_id AND b.r = a.r+dr AND b.c = a.c+dc WHERE a.mk AND NOT b.mk GROUP BY ALL),
ol AS (SELECT mm.*, nb.r IS NOT NULL AS edge FROM mm LEFT JOIN nb ON nb.scene_id = mm.scene_id AND nb.r = mm.r AND nb.c = mm.c)"""


@query("overlay", f"WITH {_SCORED}, {_HEAT_SQL}, mm AS (SELECT ht.*, nir IS NOT NULL AND x > 0.85 AS mk FROM ht JOIN sx USING (scene_id, r, c)), {_OUTLINE} SELECT scene_id, r, c, edge, "
       + ", ".join(f"CASE WHEN edge THEN {v} WHEN mk THEN floor({n}*(1-{pictures.ALPHA}::DOUBLE) + {v}*{pictures.ALPHA}::DOUBLE + 0.5)::INT ELSE {n} END AS {n}" for n, v in zip(("red8", "green8", "blue8"), _COLOUR)) + " FROM ol")
def overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A mask of strong vegetation over the heat map, with its outline."""
    px = _heat(spark, sf).withColumn("mask", F.coalesce(F.col("score") > 0.85, F.lit(False)))
    found = pictures.overlaid(px, ["red8", "green8", "blue8"], "mask", _COLOUR)
    return found.select("scene_id", "r", "c", "edge", "red8", "green8", "blue8")


@query("region_boxes", f"""{scenes_plan._COMPONENTS}, bx AS (SELECT scene_id, label, min(c) AS c0, min(r) AS r0, max(c) AS c1, max(r) AS r1 FROM nb GROUP BY ALL HAVING count(*) >= 40)
SELECT p.scene_id, p.r, p.c, count(bx.label) > 0 AS on_box FROM p LEFT JOIN bx ON bx.scene_id = p.scene_id AND p.r BETWEEN r0 AND r1 AND p.c BETWEEN c0 AND c1 AND (p.r IN (r0, r1) OR p.c IN (c0, c1)) GROUP BY ALL""")
def region_boxes(spark: SparkSession, sf: str) -> DataFrame:
    px = staged(scenes_plan._mask(spark, sf))
    found = neighbourhood.regions(px, neighbourhood.components(px, "mask"), "vv", None, 40)
    return pictures.boxed(px.select("scene_id", "r", "c"), found)


@query("thumbnail", f"WITH {_SCORED}, {_HEAT_SQL} SELECT scene_id, (r // 5)::INT AS r, (c // 5)::INT AS c, " + ", ".join(f"floor(avg({n}) + 0.5)::INT AS {n}" for n in ("red8", "green8", "blue8")) + " FROM ht GROUP BY ALL")
def thumbnail(spark: SparkSession, sf: str) -> DataFrame:
    return pictures.thumbnail(_heat(spark, sf), ["red8", "green8", "blue8"], 5)


_LONLAT = "(s_suppkey*37 % 997)/10.0 - 49.0 AS lon, (s_suppkey*61 % 991)/15.0 - 33.0 AS lat, (s_suppkey % 7 + 1)/10.0 AS d"


@query("ring_area", f"WITH s AS (SELECT s_suppkey AS scene_id, {_LONLAT} FROM supplier), e AS (SELECT scene_id, unnest([[lon, lat], [lon+d, lat], [lon+d, lat+2*d], [lon, lat+d]]) AS a, unnest([[lon+d, lat], [lon+d, lat+2*d], [lon, lat+d], [lon, lat]]) AS b FROM s) "
       f"SELECT scene_id, round(abs(sum(radians(b[1]-a[1])*(2+sin(radians(a[2]))+sin(radians(b[2])))))*{geometry.MEAN_RADIUS}::DOUBLE**2/2e6, 4) AS km2 FROM e GROUP BY 1")  # fmt: skip
def ring_area(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = scenes_plan.read(spark, sf, "supplier").select(k.alias("scene_id"), (k * 37 % 997 / 10.0 - 49.0).alias("lon"), (k * 61 % 991 / 15.0 - 33.0).alias("lat"), ((k % 7 + 1) / 10.0).alias("d"))
    lon, lat, d = F.col("lon"), F.col("lat"), F.col("d")
    ring = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((lon, lat), (lon + d, lat), (lon + d, lat + 2 * d), (lon, lat + d))])
    return rows.select("scene_id", F.round(geometry.ring_area(ring) / 1e6, 4).alias("km2"))


@query("index_features", "WITH s AS (SELECT s_suppkey AS pair_id, CASE WHEN s_suppkey % 2 = 0 THEN ['ndvi', 'ndwi', 'mndwi', 'ndbi'] WHEN s_suppkey % 3 = 0 THEN ['ndvi', 'ndwi'] ELSE ['exg'] END AS a, CASE WHEN s_suppkey % 5 = 0 THEN ['ndvi', 'ndwi'] WHEN s_suppkey % 7 = 0 THEN [] ELSE ['ndvi', 'ndwi', 'mndwi', 'ndbi', 'exg'] END AS b FROM supplier), "
       "x AS (SELECT pair_id, list_intersect(a, b) AS l FROM s) SELECT pair_id, concat_ws(',', CASE WHEN list_contains(l, 'ndvi') THEN 'ndvi' END, CASE WHEN list_contains(l, 'mndwi') THEN 'mndwi' WHEN list_contains(l, 'ndwi') THEN 'ndwi' END, CASE WHEN list_contains(l, 'ndbi') THEN 'ndbi' END) AS features FROM x")  # fmt: skip
def index_features(spark: SparkSession, sf: str) -> DataFrame:
    """The index of each property that both dates of a pair have."""
    k = F.col("s_suppkey")
    of = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    a = F.when(k % 2 == 0, of("ndvi", "ndwi", "mndwi", "ndbi")).when(k % 3 == 0, of("ndvi", "ndwi")).otherwise(of("exg"))
    b = F.when(k % 5 == 0, of("ndvi", "ndwi")).when(k % 7 == 0, of()).otherwise(of("ndvi", "ndwi", "mndwi", "ndbi", "exg"))
    return scenes_plan.read(spark, sf, "supplier").select(k.alias("pair_id"), F.array_join(spectral.shared_features(a, b), ",").alias("features"))


@query("speckle_report", f"WITH {scenes_plan._LEE}, " + scenes_plan._stats_sql("SELECT scene_id, r, c, filtered FROM l", "filtered").replace("p AS (", "p2 AS (").replace("z AS (", "z2 AS (").replace("q AS (", "q2 AS (").replace("s AS (", "s2 AS (").replace("e AS (", "e2 AS (")
       .replace("FROM p GROUP", "FROM p2 GROUP").replace("FROM p a JOIN z ", "FROM p2 a JOIN z2 ").replace("JOIN p b", "JOIN p2 b").replace("FROM q)", "FROM q2)").replace("FROM s) GROUP", "FROM s2) GROUP")
       + " SELECT e.scene_id, round(e.enl, 6) AS enl, round(e.cv, 6) AS cv_before, round(e2.cv, 6) AS cv_after, round(e.cv/nullif(e2.cv, 0), 6) AS reduction FROM e JOIN e2 USING (scene_id)")
def speckle_report(spark: SparkSession, sf: str) -> DataFrame:
    found = radar.speckle_report(pixel_grid(spark, sf), "vv")
    return found.withColumns({n: F.round(n, 6) for n in ("enl", "cv_before", "cv_after", "reduction")})


# Kernels of a scene that SQL can't express, tested against small exact cases.


@query("edge_density")
def edge_density(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.edge_density(pixel_grid(spark, sf, fields=True), "nir", "edges").select("scene_id", "r", "c", F.round("edges", 6).alias("edges"))


@query("linear_structure")
def linear_structure(spark: SparkSession, sf: str) -> DataFrame:
    return kernels.linear_structure(pixel_grid(spark, sf, fields=True), "nir", "lines").select("scene_id", "r", "c", F.round("lines", 6).alias("lines"))


@query("land_cover_with_edges")
def land_cover_with_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade: built-up land must be rich in edges, too."""
    px = pixel_grid(spark, sf, fields=True)
    px = px.withColumn("mean", spectral.band_mean([F.col(b) for b in BANDS]))
    lc = landcover.classify(kernels.edge_density(px, "mean", "edges"), list(BANDS), edges="edges")
    return landcover.class_stats(lc, 100.0)


@query("region_outlines")
def region_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Corners and shape scores of the regions of a mask."""
    found = kernels.polygons(neighbourhood.components(scenes_plan._mask(spark, sf), "mask"))
    return found.select("scene_id", "label", F.size("outline").alias("corners"), F.round("compactness", 6).alias("compactness"), F.round("rectangularity", 6).alias("rectangularity"))


@query("coregister")
def coregister(spark: SparkSession, sf: str) -> DataFrame:
    """The registration of each scene's two dates, and the shift that is kept."""
    found = registration.coregister(pixel_pair(spark, sf), list(BANDS))
    last = F.col("last")
    gate = registration.gate(F.hypot(last["offset_x"], last["offset_y"]), last["ncc"], last["score"])
    return found.withColumns(gate).select("scene_id", "method", *[F.round(c, 4).alias(n) for n, c in (("shift_x", F.col("shift_x")), ("shift_y", F.col("shift_y")), ("ncc", last["ncc"]), ("score", last["score"]))], "passed")
