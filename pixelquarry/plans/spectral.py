"""Queries on indices, thresholds and land cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions import spectral
from pixelquarry.operators import landcover, pictures, quality, thresholds
from pixelquarry.operators.staging import staged
from pixelquarry.plans import sql
from pixelquarry.sources.scenes import BANDS, pixel_grid, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
BY = ["scene_id"]
NAMES = list(sql.INDICES)
PIXEL_AREA = 100.0
AREA_SQL = "100.0::DOUBLE"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def indexed(spark: SparkSession, sf: str, in_order: bool = False) -> DataFrame:
    return landcover.with_indices(pixel_grid(spark, sf, in_order=in_order), NAMES)


def staged_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return staged(indexed(spark, sf))


#: Pixels are compared at nine places: many of their values have seven decimals, and a tie at six
#: would hang on the order of additions.
_INDEX_COLUMNS = ", ".join(f"round({e}, 9) AS {n}" for n, e in sql.INDICES.items())
_INDEXED = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in sql.INDICES.items())} FROM ({sql.PX})"


@query("spectral_indices", f"SELECT scene_id, r, c, {_INDEX_COLUMNS} FROM ({sql.PX})")
def spectral_indices(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf).select("scene_id", "r", "c", *[F.round(n, 9).alias(n) for n in NAMES])


@query(
    "index_summary",
    " UNION ALL ".join(
        f"SELECT scene_id, '{n}' AS index, round(count({n})/count(*)::DOUBLE, 4) AS valid_fraction, round(avg({n}), 4) AS mean, "
        f"round(min({n}), 4) AS min, round(max({n}), 4) AS max FROM ({_INDEXED}) GROUP BY scene_id"
        for n in NAMES
    ),
)
def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    return landcover.index_summary(indexed(spark, sf), NAMES)


_ROLES = {0: BANDS[:3], 1: BANDS[:4], 2: BANDS, 3: ("vv", "vh"), 4: ("gray",)}


@query(
    "index_availability",
    "WITH n(index, needs) AS (VALUES " + ", ".join(f"('{n}', {list(b)})" for n, b in spectral.INDEX_BANDS.items()) + "), s AS (SELECT s_suppkey AS scene_id, CASE s_suppkey % 5 "
    + " ".join(f"WHEN {k} THEN {list(v)}" for k, v in _ROLES.items()) + " END AS roles FROM supplier) SELECT scene_id, index FROM s JOIN n ON list_has_all(roles, needs)",
)
def index_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Which indices each scene's resolved roles allow: a scene for each supplier."""
    kind = F.col("s_suppkey") % len(_ROLES)
    roles = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in _ROLES.items()])
    scenes = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), roles.alias("roles"))
    needs = F.array(*[F.struct(F.lit(n).alias("index"), F.array(*map(F.lit, b)).alias("needs")) for n, b in spectral.INDEX_BANDS.items()])
    able = F.filter(needs, lambda x: F.size(F.array_except(x["needs"], F.col("roles"))) == 0)
    return scenes.select("scene_id", F.explode(able).alias("x")).select("scene_id", "x.index")


@query("valid_mask", f"SELECT scene_id, count(*) FILTER (nir IS NOT NULL) AS valid, round(1 - avg((nir IS NOT NULL)::INT), 6) AS nodata_fraction FROM ({sql.PX}) GROUP BY scene_id")
def valid_mask(spark: SparkSession, sf: str) -> DataFrame:
    ok = landcover.valid(list(BANDS))
    return pixel_grid(spark, sf).groupBy(*BY).agg(F.count_if(ok).alias("valid"), F.round(1 - F.avg(ok.cast("int")), 6).alias("nodata_fraction"))


#: Every seventh column lacks its blue band, so that some pixels are partly valid.
_MEAN = "CASE WHEN c % 7 = 3 THEN (green+red+nir+swir1+swir2)/5 ELSE (blue+green+red+nir+swir1+swir2)/6 END"


@query("band_mean", f"SELECT scene_id, r, c, round({_MEAN}, 9) AS mean FROM ({sql.PX})")
def band_mean(spark: SparkSession, sf: str) -> DataFrame:
    px = pixel_grid(spark, sf).withColumn("blue", F.when(F.col("c") % 7 != 3, F.col("blue")))
    return px.select("scene_id", "r", "c", F.round(spectral.band_mean([F.col(b) for b in BANDS]), 9).alias("mean"))


def _stretched(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN b - a >= 1e-12 THEN greatest(0, least(1, ({x}-a)/(b-a))) ELSE 0 END"


def _ends(x: str, lo: float, hi: float, px: str = sql.PX) -> str:
    return f"p AS (SELECT * FROM ({px})), e AS (SELECT scene_id, quantile_cont({x}, {lo}) AS a, quantile_cont({x}, {hi}) AS b FROM p GROUP BY scene_id)"


@query("brightness", f"WITH {_ends('(red+green+blue)/3', .01, .99)} SELECT scene_id, r, c, round({_stretched('(red+green+blue)/3', .01, .99)}, 6) AS brightness FROM p JOIN e USING (scene_id)")
def brightness(spark: SparkSession, sf: str) -> DataFrame:
    px = pixel_grid(spark, sf).withColumn("m", spectral.band_mean([F.col(b) for b in ("red", "green", "blue")]))
    return thresholds.stretch(px, "m", BY, 0.01, 0.99, "brightness").select("scene_id", "r", "c", F.round("brightness", 6).alias("brightness"))


@query(
    "rgb_composite",
    f"WITH p AS (SELECT * FROM ({sql.PX})), e AS (SELECT scene_id, "
    + ", ".join(f"quantile_cont({b}, .02) AS {b}_a, quantile_cont({b}, .98) AS {b}_b" for b in ("red", "green", "blue"))
    + " FROM p GROUP BY scene_id) SELECT scene_id, r, c, "
    + ", ".join(f"floor(coalesce(CASE WHEN {b} IS NOT NULL THEN greatest(0, least(1, ({b}-{b}_a)/({b}_b-{b}_a))) END, 0)*255)::INT AS {b}8" for b in ("red", "green", "blue"))
    + " FROM p JOIN e USING (scene_id)",
)
def rgb_composite(spark: SparkSession, sf: str) -> DataFrame:
    px = staged(pixel_grid(spark, sf, in_order=True))
    for b in ("red", "green", "blue"):
        px = thresholds.stretch(px, b, BY, 0.02, 0.98, b + "1")
    return px.select("scene_id", "r", "c", *[F.floor(F.coalesce(b + "1", F.lit(0.0)) * 255).cast("int").alias(b + "8") for b in ("red", "green", "blue")])


@query("fill_invalid", f"WITH p AS (SELECT * FROM ({sql.PX})), m AS (SELECT scene_id, median(nir) AS m FROM p GROUP BY scene_id) SELECT scene_id, r, c, round(coalesce(nir, m, 0), 6) AS nir FROM p JOIN m USING (scene_id)")
def fill_invalid(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.fill_invalid(pixel_grid(spark, sf), "nir", BY).select("scene_id", "r", "c", F.round("nir", 6).alias("nir"))


#: Values of events, in populations of 4,096.
_EVENTS = "SELECT event_id // 4096 AS scene_id, value::DOUBLE AS x, event_type FROM events"


def event_values(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.floor(F.col("event_id") / 4096.0).alias("scene_id"), F.col("value").cast("double").alias("x"), "event_type")


@query("histogram", f"WITH {sql.histogram('h', _EVENTS, 64)} SELECT scene_id, bin, n FROM h")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.histogram(event_values(spark, sf), "x", BY, 64).select("scene_id", "bin", "n")


@query(
    "histogram_summary",
    f"SELECT scene_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, .05), 6) AS p05, round(quantile_cont(x, .95), 6) AS p95, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM ({_EVENTS}) GROUP BY scene_id",
)
def histogram_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95)))
    rows = event_values(spark, sf).groupBy(*BY).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), p.alias("p"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rows.select("scene_id", *[F.round(c, 6).alias(n) for n, c in (("mean", F.col("mean")), ("std", F.col("std")), ("p05", F.col("p")[0]), ("p95", F.col("p")[1]), ("lo", F.col("lo")), ("hi", F.col("hi")))])


@query("otsu_threshold", f"WITH {sql.otsu('o', _EVENTS)} SELECT scene_id, round(threshold, 6) AS threshold, round(quality, 6) AS quality FROM o_o")
def otsu_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.otsu(event_values(spark, sf), "x", BY).select("scene_id", F.round("threshold", 6).alias("threshold"), F.round("quality", 6).alias("quality"))


_MULTI = f"""WITH {sql.histogram('h', _EVENTS, 128)}, {sql.shares('h', 128)}, {sql.three_classes('q', 'h_s')}
SELECT scene_id, round(low, 6) AS low, round(high, 6) AS high, round(quality, 6) AS quality FROM q"""


@query("multilevel_otsu", _MULTI)
def multilevel_otsu(spark: SparkSession, sf: str) -> DataFrame:
    found = thresholds.multilevel_otsu(event_values(spark, sf), "x", BY)
    return found.select("scene_id", *[F.round(c, 6).alias(c) for c in ("low", "high", "quality")])


@query("mode_prominence", f"WITH {sql.otsu('o', _EVENTS)}, {sql.prominence('h', _EVENTS, 'o_o', 'threshold')} SELECT scene_id, round(prominence, 6) AS prominence FROM h_pr")
def mode_prominence(spark: SparkSession, sf: str) -> DataFrame:
    values = event_values(spark, sf)
    found = thresholds.mode_prominence(values, "x", thresholds.otsu(values, "x", BY), BY, "threshold")
    return found.select("scene_id", F.round("prominence", 6).alias("prominence"))


@query("bimodality", f"WITH {sql.bimodality('o', _EVENTS)} SELECT scene_id, round(bimodality, 6) AS bimodality FROM o_bi")
def bimodality(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.bimodality(event_values(spark, sf), "x", BY).select("scene_id", F.round("bimodality", 6).alias("bimodality"))


@query(
    "separability",
    f"WITH a AS (SELECT scene_id, avg(x) FILTER (event_type = 'click') AS a1, avg(x) FILTER (event_type <> 'click') AS a0, "
    f"var_pop(x) FILTER (event_type = 'click') AS v1, var_pop(x) FILTER (event_type <> 'click') AS v0, "
    f"count(x) FILTER (event_type = 'click') AS n1, count(x) FILTER (event_type <> 'click') AS n0 FROM ({_EVENTS}) GROUP BY scene_id) "
    "SELECT scene_id, round(CASE WHEN n1 < 8 OR n0 < 8 THEN 0.0 WHEN sqrt(.5*(v1+v0)) < 1e-9 THEN CASE WHEN abs(a1-a0) > 1e-9 THEN 1.0 ELSE 0.0 END "
    "ELSE least(1.0, abs(a1-a0)/sqrt(.5*(v1+v0))/2) END, 6) AS separability FROM a",
)
def separability(spark: SparkSession, sf: str) -> DataFrame:
    found = thresholds.separability(event_values(spark, sf), "x", F.col("event_type") == "click", BY)
    return found.select("scene_id", F.round("separability", 6).alias("separability"))


@query(
    "outlier_bound",
    f"WITH v AS ({_EVENTS}), m AS (SELECT scene_id, median(x) AS m FROM v GROUP BY scene_id) SELECT scene_id, round(any_value(m) + 3*1.4826*median(abs(x-m)), 6) AS bound FROM v JOIN m USING (scene_id) GROUP BY scene_id",
)
def outlier_bound(spark: SparkSession, sf: str) -> DataFrame:
    return thresholds.outlier_bound(event_values(spark, sf), "x", BY).select("scene_id", F.round("bound", 6).alias("bound"))


_ADAPTIVE = "SELECT scene_id, round(threshold, 6) AS threshold, method, round(quality, 6) AS quality FROM o_a"


@query("adaptive_threshold", f"WITH {sql.adaptive('o', f'SELECT scene_id, ndvi AS x FROM ({_INDEXED})', .3)} {_ADAPTIVE}")
def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = thresholds.adaptive_threshold(staged_indexed(spark, sf), "ndvi", BY, 0.30)
    return found.select("scene_id", F.round("threshold", 6).alias("threshold"), "method", F.round("quality", 6).alias("quality"))


@query("region_threshold", f"WITH {sql.adaptive('o', f'SELECT scene_id, ndbi AS x FROM ({_INDEXED}) WHERE ndvi > 0.3', 0.0, True)} {_ADAPTIVE}")
def region_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = thresholds.adaptive_threshold(staged_indexed(spark, sf).where("ndvi > 0.3"), "ndbi", BY, 0.0, True)
    return found.select("scene_id", F.round("threshold", 6).alias("threshold"), "method", F.round("quality", 6).alias("quality"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return landcover.classify(pixel_grid(spark, sf, fields=True), list(BANDS))


_LC = f"WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)}"


@query("land_cover_map", f"{_LC} SELECT scene_id, r, c, class_code::INT AS class_code, round(evidence, 6) AS evidence FROM lc")
def land_cover_map(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).select("scene_id", "r", "c", "class_code", F.round("evidence", 6).alias("evidence"))


@query(
    "land_cover_stats",
    f"{_LC}, t AS (SELECT scene_id, count(*) FILTER (valid) AS total FROM lc GROUP BY 1) SELECT scene_id, {sql.CLASS_NAME} AS class, count(*) AS pixel_count, round(count(*)/any_value(total)::DOUBLE, 6) AS fraction, "
    f"round(count(*)*{AREA_SQL}, 6) AS area_m2, round(avg(evidence), 6) AS mean_evidence FROM lc JOIN t USING (scene_id) WHERE class_code > 0 GROUP BY scene_id, class_code",
)
def land_cover_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = landcover.class_stats(classified(spark, sf), PIXEL_AREA)
    return stats.select("scene_id", "class", "pixel_count", *[F.round(c, 6).alias(c) for c in ("fraction", "area_m2", "mean_evidence")])


@query("land_cover_dominant", f"{_LC} SELECT scene_id, {sql.CLASS_NAME} AS class, count(*) AS pixel_count FROM lc WHERE class_code > 0 GROUP BY scene_id, class_code QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, class) = 1")
def land_cover_dominant(spark: SparkSession, sf: str) -> DataFrame:
    return landcover.dominant(landcover.class_stats(classified(spark, sf), None), BY, "class")


_RGB = f"""WITH RECURSIVE p AS (SELECT * FROM ({sql.FIELDS})), e AS (SELECT scene_id, {", ".join(f"quantile_cont({x}, .01) AS {x}_a, quantile_cont({x}, .99) AS {x}_b" for x in ("red", "green", "blue"))} FROM p GROUP BY scene_id),
b0 AS (SELECT *, ({" + ".join(f"CASE WHEN {x}_b - {x}_a >= 1e-12 THEN greatest(0, least(1, ({x}-{x}_a)/({x}_b-{x}_a))) ELSE 0 END" for x in ("red", "green", "blue"))})/3 AS br, {sql.INDICES['exg']} AS exg, red IS NOT NULL AS valid FROM p JOIN e USING (scene_id)),
b01 AS (SELECT *, CASE WHEN valid THEN br END AS bright FROM b0),
{sql.adaptive('d', 'SELECT scene_id, bright AS x FROM b01', .35)},
b1 AS (SELECT b.*, coalesce(valid AND blue > red AND bright < threshold, false) AS raw FROM b01 b JOIN d_a USING (scene_id)),
{sql.cleaned('x', 'b1', 'raw', 25)},
b2 AS (SELECT b.*, x.r IS NOT NULL AS wat FROM b1 b LEFT JOIN x ON x.scene_id = b.scene_id AND x.r = b.r AND x.c = b.c),
{sql.adaptive('g', 'SELECT scene_id, CASE WHEN valid AND NOT wat THEN exg END AS x FROM b2', .05, True)},
z AS (SELECT scene_id, CASE WHEN wat THEN 1 WHEN coalesce(exg > threshold, false) AND valid THEN 2 WHEN valid THEN 4 ELSE 0 END AS class_code FROM b2 JOIN g_a USING (scene_id))
SELECT scene_id, class_code::INT AS class_code, count(*) AS pixel_count FROM z GROUP BY ALL"""


@query("land_cover_rgb", _RGB)
def land_cover_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return landcover.classify_rgb(pixel_grid(spark, sf, fields=True)).groupBy("scene_id", "class_code").agg(F.count("*").alias("pixel_count"))


@query(
    "class_colours",
    f"{_LC} SELECT CASE class_code WHEN 1 THEN '#2b6cb0' WHEN 2 THEN '#2f855a' WHEN 3 THEN '#c53030' WHEN 4 THEN '#b7791f' ELSE '#000000' END AS colour, count(*) AS pixels FROM lc GROUP BY 1",
)
def class_colours(spark: SparkSession, sf: str) -> DataFrame:
    """A class map coloured through a five-row dimension of our own colours."""
    colours = spark.createDataFrame(list(pictures.CLASS_COLOURS.items()), "class_code int, colour string")
    return classified(spark, sf).join(F.broadcast(colours), "class_code").groupBy("colour").agg(F.count("*").alias("pixels"))


@query("index_heatmap", f"SELECT scene_id, r, c, CASE WHEN nir IS NOT NULL THEN floor(greatest(0, least(1, (({sql.INDICES['ndvi']})+1)/2))*255)::INT END AS level FROM ({sql.PX})")
def index_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return indexed(spark, sf, in_order=True).select("scene_id", "r", "c", F.floor(spectral.score_map(F.col("ndvi")) * 255).cast("int").alias("level"))


_SCORES = {"water": "coalesce({mndwi}, {ndwi})", "vegetation": "{ndvi}", "built_up": "{ndbi}"}


@query(
    "score_map",
    " UNION ALL ".join(f"SELECT scene_id, r, c, '{k}' AS class, round(greatest(0, least(1, ({x.format(**sql.INDICES)}+1)/2)), 6) AS score FROM ({sql.PX}) WHERE nir IS NOT NULL" for k, x in _SCORES.items()),
)
def score_map(spark: SparkSession, sf: str) -> DataFrame:
    """The strength of each class that has an index: water, vegetation and built-up, not bare soil."""
    rows = indexed(spark, sf).where("nir IS NOT NULL")
    scores = F.array(*[F.struct(F.lit(k).alias("class"), landcover.class_score(k, NAMES).alias("score")) for k in _SCORES])
    return rows.select("scene_id", "r", "c", F.explode(scores).alias("s")).select("scene_id", "r", "c", "s.class", F.round("s.score", 6).alias("score"))


_LAPLACE = """l0 AS (SELECT scene_id, r, c, greatest(0, least(1, (coalesce(blue, m)-a)/(b-a))) AS x FROM p JOIN (SELECT scene_id, median(blue) AS m FROM p GROUP BY 1) USING (scene_id)
  JOIN (SELECT scene_id, quantile_cont(coalesce(blue, m), .01) AS a, quantile_cont(coalesce(blue, m), .99) AS b FROM p JOIN (SELECT scene_id, median(blue) AS m FROM p GROUP BY 1) USING (scene_id) GROUP BY 1) USING (scene_id)),
z AS (SELECT scene_id, max(r) AS h, max(c) AS w FROM p GROUP BY 1),
l1 AS (SELECT a.scene_id, a.r, a.c, sum(k*b.x) AS lap FROM l0 a JOIN z USING (scene_id), (VALUES (0,0,-4),(0,1,1),(0,-1,1),(1,0,1),(-1,0,1)) o(dr, dc, k)
  JOIN l0 b ON b.scene_id = a.scene_id AND b.r = (CASE WHEN a.r+dr < 0 THEN 1 WHEN a.r+dr > h THEN h-1 ELSE a.r+dr END) AND b.c = (CASE WHEN a.c+dc < 0 THEN 1 WHEN a.c+dc > w THEN w-1 ELSE a.c+dc END) GROUP BY ALL),
sh AS (SELECT scene_id, least(1, var_pop(lap)*20) AS sharpness FROM l1 GROUP BY 1)"""


@query(
    "input_quality",
    f"WITH p AS (SELECT * FROM ({sql.PX})), {_LAPLACE}, bd AS (" + " UNION ALL ".join(f"SELECT scene_id, '{b}' AS band, {b} AS x FROM p" for b in BANDS) + "), "
    "en AS (SELECT scene_id, band, quantile_cont(x, .02) AS lo, quantile_cont(x, .98) AS hi, min(x) AS mn, greatest(max(x)-min(x), 1e-9) AS span FROM bd GROUP BY ALL), "
    "ba AS (SELECT scene_id, band, any_value((hi-lo)/span) AS rng, avg((x <= mn + span*0.005 OR x >= mn + span - span*0.005)::INT) AS sat FROM bd JOIN en USING (scene_id, band) WHERE x IS NOT NULL GROUP BY ALL), "
    "me AS (SELECT scene_id, avg(rng) AS dr, avg(sat) AS sf FROM ba GROUP BY 1), nd AS (SELECT scene_id, avg((nir IS NULL)::INT) AS nd FROM p GROUP BY 1), "
    "q AS (SELECT scene_id, nd, dr, sf, sharpness AS sh, greatest(0, least(1, .35*(1-nd) + .30*least(dr/0.5, 1) + .20*(1-least(sf/0.4, 1)) + .15*least(sharpness/0.1, 1))) AS score FROM me JOIN nd USING (scene_id) JOIN sh USING (scene_id)) "
    "SELECT scene_id, round(nd, 4) AS nodata_fraction, round(dr, 4) AS dynamic_range, round(sf, 4) AS saturation_fraction, round(sh, 4) AS sharpness, round(score, 4) AS score, "
    "concat_ws(',', CASE WHEN nd > .5 THEN 'mostly_nodata' WHEN nd > .15 THEN 'some_nodata' END, CASE WHEN dr < .15 THEN 'low_contrast' END, CASE WHEN sf > .25 THEN 'saturated' END, CASE WHEN sh < .02 THEN 'blurred' END) AS warnings FROM q",
)
def input_quality(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.input_quality(pixel_grid(spark, sf), list(BANDS))
    numbers = ("nodata_fraction", "dynamic_range", "saturation_fraction", "sharpness", "score")
    return found.select("scene_id", *[F.round(n, 4).alias(n) for n in numbers], F.array_join("warnings", ",").alias("warnings"))
