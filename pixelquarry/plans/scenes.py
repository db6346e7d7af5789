"""Queries on radar, fusion, change, neighbourhoods and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions import spectral
from pixelquarry.operators import change, grounding, kernels, landcover, mosaic, neighbourhood, radar, registration
from pixelquarry.operators.staging import staged
from pixelquarry.plans import sql
from pixelquarry.sources.scenes import BANDS, HEIGHT, pixel_grid, pixel_pair, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
BY = ["scene_id"]
AREA = 100.0
#: The same in SQL, where a plain literal would be a decimal.
AREA_SQL = "100.0::DOUBLE"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- radar -----------------------------------------------------------------------------------

_DB = "CASE WHEN vv IS NOT NULL THEN 10*log10(greatest(vv, 1e-10)) END"


@query("backscatter_db", f"SELECT scene_id, r, c, round({_DB}, 9) AS db, round(pow(10.0, ({_DB})/10), 9) AS power FROM ({sql.PX})")
def backscatter_db(spark: SparkSession, sf: str) -> DataFrame:
    db = spectral.to_db(F.col("vv"))
    return pixel_grid(spark, sf).select("scene_id", "r", "c", F.round(db, 9).alias("db"), F.round(spectral.to_linear(db), 9).alias("power"))


@query("looks_like_db", f"SELECT scene_id, coalesce(min(x) < 0 AND min(x) >= -60 AND median(x) <= 0, false) AS is_db FROM (SELECT scene_id, {_DB} AS x FROM ({sql.PX})) GROUP BY scene_id")
def looks_like_db(spark: SparkSession, sf: str) -> DataFrame:
    return radar.looks_like_db(pixel_grid(spark, sf).withColumn("db", spectral.to_db(F.col("vv"))), "db")


def _stats_sql(px: str, x: str, k: int = 3) -> str:
    """CTEs q and s (power, share, mean, var) by joining each pixel's window, edges repeated."""
    n = (2 * k + 1) ** 2
    return f"""p AS (SELECT scene_id, r, c, CASE WHEN {x} > 0 THEN {x} END AS x FROM ({px})),
z AS (SELECT scene_id, max(r) AS h, max(c) AS w FROM p GROUP BY 1),
q AS (SELECT a.scene_id, a.r, a.c, any_value(a.x) AS power, sum(coalesce(b.x, 0))/{n} AS sx, sum(coalesce(b.x*b.x, 0))/{n} AS sxx, sum((b.x IS NOT NULL)::INT)/{n}.0 AS ok
  FROM p a JOIN z USING (scene_id), range(-{k}, {k + 1}) i(dr), range(-{k}, {k + 1}) j(dc)
  JOIN p b ON b.scene_id = a.scene_id AND b.r = greatest(0, least(h, a.r + dr)) AND b.c = greatest(0, least(w, a.c + dc)) GROUP BY ALL),
s AS (SELECT scene_id, r, c, power, ok AS share, CASE WHEN ok > 1e-9 THEN sx/ok ELSE 0 END AS mean,
  greatest((CASE WHEN ok > 1e-9 THEN sxx/ok ELSE 0 END) - (CASE WHEN ok > 1e-9 THEN sx/ok ELSE 0 END)**2, 0) AS var FROM q),
e AS (SELECT scene_id, CASE WHEN count(power) < {n * 4} OR median(cv) IS NULL THEN 1.0 WHEN median(cv) <= 1e-6 THEN 64.0 ELSE greatest(1.0, least(64.0, 1/(median(cv)**2))) END AS enl,
  coalesce(median(cv), 0) AS cv FROM (SELECT scene_id, power, CASE WHEN share > 0.999 AND mean > 1e-12 AND power IS NOT NULL THEN sqrt(var)/mean END AS cv FROM s) GROUP BY scene_id)"""


_LEE = f"""{_stats_sql(sql.PX, 'vv')},
l AS (SELECT scene_id, r, c, CASE WHEN power IS NOT NULL THEN CASE WHEN o > 0 THEN o ELSE mean END END AS filtered FROM (
  SELECT scene_id, r, c, power, mean, mean + (CASE WHEN var > 1e-20 THEN greatest(var - mean*mean/enl, 0)/(1+1/enl)/var ELSE 0 END)*(power-mean) AS o FROM s JOIN e USING (scene_id))),
f AS (SELECT scene_id, r, c, CASE WHEN filtered IS NOT NULL THEN 10*log10(greatest(filtered, 1e-10)) END AS db FROM l)"""


@query("box_mean", f"WITH {_stats_sql(sql.PX, 'vv')} SELECT scene_id, r, c, round(sx, 9) AS mean FROM q")
def box_mean(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.box_mean(pixel_grid(spark, sf), ["vv"], 7).select("scene_id", "r", "c", F.round("vv", 9).alias("mean"))


@query("equivalent_looks", f"WITH {_stats_sql(sql.PX, 'vv')} SELECT scene_id, round(cv, 6) AS cv, round(enl, 6) AS enl FROM e")
def equivalent_looks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(radar.looks(radar.local_statistics(pixel_grid(spark, sf), "vv")), "cv", "enl")


@query("lee_filter", f"WITH {_LEE} SELECT scene_id, r, c, round(db, 6) AS db FROM f")
def lee_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(radar.despeckle(pixel_grid(spark, sf), "vv"), "db")


def _regimes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    db = staged(radar.despeckle(pixel_grid(spark, sf), "vv"))
    cuts = staged(radar.regime_thresholds(db, "db"))
    return radar.regime_map(db, "db", cuts), cuts


_CUTS = f"""{_LEE}, {sql.histogram('h', 'SELECT scene_id, db AS x FROM f', 256)}, {sql.shares('h', 256)}, {sql.three_classes('k', 'h_s')},
{sql.prominence('sm', 'SELECT scene_id, db AS x FROM f JOIN k USING (scene_id) WHERE db <= high', 'k', 'low')},
tl AS (SELECT scene_id, db AS x FROM f JOIN k USING (scene_id) WHERE db >= high), {sql.otsu('u', 'SELECT * FROM tl WHERE scene_id IN (SELECT scene_id FROM tl GROUP BY 1 HAVING count(*) >= 64)')},
{sql.prominence('br', 'SELECT scene_id, db AS x FROM f JOIN k USING (scene_id) WHERE db >= low', 'u_o', 'threshold')},
t AS (SELECT k.scene_id, low, high, coalesce(sm_pr.prominence, 0) AS smooth_prominence, CASE WHEN u_o.threshold IS NOT NULL THEN br_pr.prominence ELSE 0 END AS bright_prominence,
  CASE WHEN sm_pr.prominence >= 0.25 THEN low END AS smooth_db, CASE WHEN br_pr.prominence >= 0.25 THEN u_o.threshold END AS bright_db
  FROM k LEFT JOIN sm_pr USING (scene_id) LEFT JOIN u_o USING (scene_id) LEFT JOIN br_pr USING (scene_id)),
g AS (SELECT scene_id, r, c, db, CASE WHEN db IS NULL THEN 0 WHEN db > bright_db THEN 3 WHEN db < smooth_db THEN 1 ELSE 2 END AS regime_code FROM f LEFT JOIN t USING (scene_id))"""
_REGIME = "CASE regime_code WHEN 1 THEN 'smooth' WHEN 2 THEN 'diffuse' WHEN 3 THEN 'double_bounce' ELSE 'unclassified' END"


@query("regime_thresholds", f"WITH {_CUTS} SELECT scene_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("low", "high", "smooth_db", "bright_db", "smooth_prominence", "bright_prominence")) + " FROM t")
def regime_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_regimes(spark, sf)[1], "low", "high", "smooth_db", "bright_db", "smooth_prominence", "bright_prominence")


@query("regime_stats", f"WITH {_CUTS} SELECT scene_id, {_REGIME} AS regime, count(*) AS pixel_count, round(count(*)/sum(count(*)) OVER (PARTITION BY scene_id), 6) AS fraction, "
       f"round(count(*)*{AREA_SQL}, 6) AS area_m2, round(avg(db), 6) AS mean_db FROM g WHERE regime_code > 0 GROUP BY scene_id, regime_code")  # fmt: skip
def regime_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(radar.regime_stats(_regimes(spark, sf)[0], "db", AREA), "fraction", "area_m2", "mean_db")


# --- fusion: radar regimes from fixed reference cuts, so that every conflict rule is met ----------

_LOW, _HIGH = -12.0, -6.0


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    """In every second scene radar separated bright returns, and so decides on built-up land."""
    px = pixel_grid(spark, sf, fields=True)
    bright = F.when(F.col("vv").isNotNull(), spectral.to_db(F.col("vv")))
    regimes = radar.coded(px.withColumn("db", bright), "db", F.lit(_LOW), F.lit(_HIGH))
    return radar.fuse(landcover.classify(px, list(BANDS)), regimes, F.col("scene_id") % 2 == 0)


_FUSED = f"""WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)},
rg AS (SELECT scene_id, r, c, CASE WHEN db IS NULL THEN 0 WHEN db > {_HIGH} THEN 3 WHEN db < {_LOW} THEN 1 ELSE 2 END AS regime_code FROM (SELECT scene_id, r, c, {_DB} AS db FROM ({sql.PX}))),
j AS (SELECT scene_id, r, c, class_code, regime_code, scene_id % 2 = 0 AS dec, (regime_code = 1 AND class_code IN (1, 4)) OR (regime_code = 2 AND class_code IN (2, 4)) OR (regime_code = 3 AND class_code = 3) AS fits
  FROM lc JOIN rg USING (scene_id, r, c)),
v AS (SELECT *, CASE WHEN class_code > 0 AND regime_code > 0 AND fits THEN 1 WHEN class_code > 0 AND regime_code > 0 THEN 2 WHEN class_code > 0 THEN 3 WHEN regime_code > 0 THEN 4 ELSE 0 END AS ev FROM j),
fu AS (SELECT *, CASE WHEN ev = 2 AND regime_code = 3 THEN 3 WHEN ev = 2 AND class_code = 3 AND dec THEN 4 WHEN ev = 4 THEN CASE WHEN regime_code = 3 THEN 3 ELSE 0 END ELSE class_code END AS fused,
  CASE WHEN ev <> 2 THEN NULL WHEN regime_code = 3 THEN 'sar' WHEN class_code = 3 THEN CASE WHEN dec THEN 'sar' ELSE 'none' END ELSE 'optical' END AS arbiter FROM v)"""
_NAME = "CASE {} WHEN 1 THEN 'water' WHEN 2 THEN 'vegetation' WHEN 3 THEN 'built_up' WHEN 4 THEN 'bare_soil' ELSE 'unclassified' END"


@query("fusion_stats", f"{_FUSED} SELECT scene_id, {_NAME.format('fused')} AS class, count(*) AS pixel_count, round(count(*)/sum(count(*)) OVER (PARTITION BY scene_id), 6) AS fraction, "
       "round(count(*) FILTER (ev = 1)/count(*)::DOUBLE, 6) AS corroborated_fraction FROM fu WHERE fused > 0 GROUP BY scene_id, fused")  # fmt: skip
def fusion_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(radar.fused_stats(_fused(spark, sf)).drop("evidence"), "fraction", "corroborated_fraction")


@query("fusion_evidence", f"{_FUSED} SELECT scene_id, CASE ev WHEN 1 THEN 'both' WHEN 2 THEN 'conflict' WHEN 3 THEN 'optical_only' WHEN 4 THEN 'sar_only' END AS evidence, {_NAME.format('fused')} AS class, count(*) AS n "
       "FROM fu WHERE fused > 0 GROUP BY ALL")  # fmt: skip
def fusion_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return radar.fused_stats(_fused(spark, sf)).select("scene_id", "class", F.explode("evidence").alias("evidence", "n"))


@query("fusion_conflicts", f"{_FUSED}, n AS (SELECT scene_id, count(*) AS total FROM fu GROUP BY 1) SELECT scene_id, {_NAME.format('class_code')} AS optical_class, {_REGIME} AS sar_regime, count(*) AS pixel_count, "
       f"round(count(*)/any_value(total)::DOUBLE, 6) AS fraction, round(count(*)*{AREA_SQL}, 6) AS area_m2, {_NAME.format('fused')} AS resolved_as, arbiter FROM fu JOIN n USING (scene_id) WHERE ev = 2 GROUP BY scene_id, class_code, regime_code, fused, arbiter")  # fmt: skip
def fusion_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(radar.conflict_groups(_fused(spark, sf), AREA), "fraction", "area_m2")


@query("fusion_agreement", f"{_FUSED} SELECT scene_id, round(count(*) FILTER (ev = 1)/nullif(count(*) FILTER (ev IN (1, 2)), 0)::DOUBLE, 6) AS agreement FROM fu GROUP BY scene_id")
def fusion_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(radar.agreement(_fused(spark, sf)), "agreement")


# --- change ----------------------------------------------------------------------------------


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    dated = landcover.classify(pixel_pair(spark, sf), list(BANDS), ["scene_id", "date"])
    return change.co_grid(dated, [*change.FEATURES, "class_code", "valid"])


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    return staged(change.detect(_pair(spark, sf)))


_PAIR = f"""WITH RECURSIVE {sql.landcover('lb', sql.BEFORE)}, {sql.landcover('la', sql.AFTER)},
pr AS MATERIALIZED (SELECT scene_id, r, c, b.class_code AS cb, a.class_code AS ca, b.valid AND a.valid AS valid, b.ndvi AS ndvi_b, a.ndvi AS ndvi_a, b.mndwi AS mndwi_b, a.mndwi AS mndwi_a, b.ndbi AS ndbi_b, a.ndbi AS ndbi_a
  FROM lb b JOIN la a USING (scene_id, r, c)),
mg AS MATERIALIZED (SELECT *, CASE WHEN valid THEN sqrt(((ndvi_a-ndvi_b)**2 + (mndwi_a-mndwi_b)**2 + (ndbi_a-ndbi_b)**2)/3) END AS magnitude FROM pr),
{sql.adaptive('mt', 'SELECT scene_id, magnitude AS x FROM mg', 0.0)},
md AS (SELECT scene_id, median(magnitude) AS m FROM mg GROUP BY 1),
ob AS (SELECT scene_id, any_value(m) + CASE WHEN median(abs(magnitude-m)) > 0 THEN 3*1.4826*median(abs(magnitude-m)) ELSE any_value(m)*1.2e-16 END AS bound FROM mg JOIN md USING (scene_id) GROUP BY 1),
ct AS (SELECT scene_id, CASE WHEN method = 'otsu' THEN threshold ELSE bound END AS cut FROM mt_a LEFT JOIN ob USING (scene_id)),
dr AS MATERIALIZED (SELECT mg.*, coalesce(valid AND magnitude > cut, false) AS rs, coalesce(valid AND cb > 0 AND ca > 0 AND cb <> ca, false) AS rc FROM mg LEFT JOIN ct USING (scene_id)),
{sql.cleaned('cs', 'dr', 'rs', 25)}, {sql.cleaned('cc', 'dr', 'rc', 25)},
de AS (SELECT dr.*, valid AND cs.r IS NOT NULL AS spectral, valid AND cc.r IS NOT NULL AS by_class FROM dr LEFT JOIN cs ON cs.scene_id = dr.scene_id AND cs.r = dr.r AND cs.c = dr.c LEFT JOIN cc ON cc.scene_id = dr.scene_id AND cc.r = dr.r AND cc.c = dr.c),
ch AS MATERIALIZED (SELECT *, spectral OR by_class AS changed FROM de)"""
_TYPE = ("CASE WHEN cb = ca THEN 'spectral_only' WHEN cb = 0 OR ca = 0 THEN 'other' WHEN ca = 1 THEN 'water_gain' WHEN ca = 2 THEN 'vegetation_gain' WHEN ca = 3 THEN 'urban_expansion' "
         "WHEN cb = 1 THEN 'water_loss' WHEN cb = 2 THEN 'vegetation_loss' ELSE 'urban_loss' END")  # fmt: skip


@query("change_map", f"{_PAIR} SELECT scene_id, r, c, round(magnitude, 6) AS magnitude, spectral, by_class, changed FROM ch")
def change_map(spark: SparkSession, sf: str) -> DataFrame:
    return _detected(spark, sf).select("scene_id", "r", "c", F.round("magnitude", 6).alias("magnitude"), "spectral", "by_class", "changed")


@query("change_transitions", f"{_PAIR} SELECT scene_id, {_NAME.format('cb')} AS before, {_NAME.format('ca')} AS after, {_TYPE} AS change_type, count(*) AS pixel_count, "
       f"round(count(*)/sum(count(*)) OVER (PARTITION BY scene_id), 6) AS fraction_of_change, round(count(*)*{AREA_SQL}, 6) AS area_m2, round(avg(magnitude), 6) AS mean_magnitude, "
       "round(avg(spectral::INT), 6) AS spectral_agreement FROM ch WHERE changed GROUP BY scene_id, cb, ca")  # fmt: skip
def change_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(change.transitions(_detected(spark, sf), AREA), "fraction_of_change", "area_m2", "mean_magnitude", "spectral_agreement")


@query("change_reportable", f"{_PAIR}, tr AS (SELECT scene_id, {_TYPE} AS change_type, cb, ca, count(*) AS pixel_count, avg(spectral::INT) AS ag FROM ch WHERE changed GROUP BY scene_id, cb, ca) "
       "SELECT scene_id, change_type, pixel_count, scene_id % 3 <> 1 AND ag >= 0.6 AND change_type <> 'spectral_only' AS reportable, CASE WHEN scene_id % 3 = 1 THEN 'registration' WHEN ag < 0.6 THEN 'agreement' END AS withheld FROM tr")  # fmt: skip
def change_reportable(spark: SparkSession, sf: str) -> DataFrame:
    """Every third scene's pair counts as not registered."""
    found = change.reportable(change.transitions(_detected(spark, sf), AREA), F.col("scene_id") % 3 != 1)
    return found.select("scene_id", "change_type", "pixel_count", "reportable", "withheld")


@query("class_deltas", f"{_PAIR}, d AS (SELECT scene_id, k, count(*) FILTER (valid AND cb = k) AS before, count(*) FILTER (valid AND ca = k) AS after FROM pr, range(1, 5) g(k) GROUP BY ALL) "
       f"SELECT scene_id, {_NAME.format('k')} AS class, before, after, after-before AS delta, round(CASE WHEN before > 0 THEN (after-before)/before::DOUBLE END, 6) AS relative, round((after-before)*{AREA_SQL}, 6) AS delta_m2 FROM d WHERE before + after > 0")  # fmt: skip
def class_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(change.class_deltas(_pair(spark, sf), AREA), "relative", "delta_m2")


@query("index_deltas", _PAIR + " " + " UNION ALL ".join(
    f"SELECT scene_id, '{n}' AS index, round(avg({n}_b) FILTER (valid), 6) AS mean_before, round(avg({n}_a) FILTER (valid), 6) AS mean_after, round(avg({n}_a-{n}_b) FILTER (changed), 6) AS mean_delta, "
    f"round(avg(({n}_a-{n}_b > 0)::INT) FILTER (changed), 6) AS increasing, CASE WHEN avg(({n}_a-{n}_b > 0)::INT) FILTER (changed) >= 0.6 THEN 'increase' WHEN avg(({n}_a-{n}_b > 0)::INT) FILTER (changed) <= 0.4 THEN 'decrease' ELSE 'mixed' END AS direction FROM ch GROUP BY scene_id"
    for n in change.FEATURES))
def index_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(change.index_deltas(_detected(spark, sf)), "mean_before", "mean_after", "mean_delta", "increasing")


@query("evidence_split", f"{_PAIR} SELECT scene_id, count(*) FILTER (spectral AND by_class) AS corroborated, count(*) FILTER (spectral AND NOT by_class) AS spectral_only, "
       "count(*) FILTER (by_class AND NOT spectral) AS class_only, round(count(*) FILTER (spectral AND by_class)/nullif(count(*) FILTER (changed), 0)::DOUBLE, 6) AS corroborated_fraction FROM ch GROUP BY scene_id")  # fmt: skip
def evidence_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(change.evidence_split(_detected(spark, sf)), "corroborated_fraction")


@query("match_radiometry", "WITH " + ", ".join(
    f"{x}p AS (SELECT scene_id, r, c, b.{x} AS x, a.{x} AS y FROM ({sql.BEFORE}) b JOIN ({sql.AFTER}) a USING (scene_id, r, c)), "
    f"{x}s AS (SELECT scene_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM {x}p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1), "
    f"{x}o AS (SELECT scene_id, r, c, round(CASE WHEN n >= 100 AND sy > 1e-12 THEN CASE WHEN sx > 1e-12 THEN (y-my)*sx/sy+mx ELSE y-my+mx END ELSE y END, 6) AS {x} FROM {x}p LEFT JOIN {x}s USING (scene_id))"
    for x in BANDS) + f" SELECT scene_id, r, c, {', '.join(BANDS)} FROM " + " JOIN ".join(f"{x}o" + " USING (scene_id, r, c)" * (x != BANDS[0]) for x in BANDS))
def match_radiometry(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(change.match_radiometry(pixel_pair(spark, sf), list(BANDS)), *BANDS)


_SHARED = ("red", "nir")


@query("joint_band_stack", "WITH " + ", ".join(
    f"{x}p AS (SELECT scene_id, r, c, b.{x} AS x, a.{x} AS y FROM ({sql.BEFORE}) b JOIN ({sql.AFTER}) a USING (scene_id, r, c)), "
    f"{x}e AS (SELECT scene_id, quantile_cont(v, .01) AS lo, quantile_cont(v, .99) AS hi FROM (SELECT scene_id, x AS v FROM {x}p UNION ALL SELECT scene_id, y FROM {x}p) GROUP BY 1), "
    f"{x}o AS (SELECT scene_id, r, c, " + ", ".join(f"CASE WHEN {v} IS NOT NULL THEN greatest(0, least(1, ({v}-lo)/(hi-lo))) END AS {x}_{d}" for v, d in (("x", "b"), ("y", "a"))) + f" FROM {x}p JOIN {x}e USING (scene_id))"
    for x in _SHARED) + " SELECT scene_id, r, c, " + ", ".join(f"round({x}_{d}, 6) AS {x}_{d}" for x in _SHARED for d in "ba")
    + ", round(CASE WHEN red_a IS NOT NULL AND red_b IS NOT NULL THEN sqrt(((red_a-red_b)**2+(nir_a-nir_b)**2)/2) END, 6) AS magnitude FROM redo JOIN niro USING (scene_id, r, c)")
def joint_band_stack(spark: SparkSession, sf: str) -> DataFrame:
    """Where no index can be had of both dates: shared bands scaled by both dates' percentiles."""
    found = change.joint_band_stack(pixel_pair(spark, sf), list(_SHARED))
    names = [f"{x}_{d}" for x in _SHARED for d in "ba"]
    return rounded(found.select("scene_id", "r", "c", *names, "magnitude"), *names, "magnitude")


# --- neighbourhoods and regions --------------------------------------------------------------

def _sobel_sql(px: str, x: str, name: str) -> str:
    """CTE ``name`` (scene_id, r, c, gx, gy, lap): borders reflect, null counts as 0."""
    fold = lambda v, top: f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > {top} THEN 2*{top}-({v}) ELSE {v} END)"
    return f"""{name}_p AS (SELECT scene_id, r, c, coalesce({x}, 0) AS x FROM ({px})), {name}_z AS (SELECT scene_id, max(r) AS h, max(c) AS w FROM {name}_p GROUP BY 1),
{name} AS (SELECT a.scene_id, a.r, a.c, sum(dc*(2-abs(dr))*b.x) AS gx, sum(dr*(2-abs(dc))*b.x) AS gy,
  sum((CASE WHEN dr = 0 AND dc = 0 THEN -4 WHEN abs(dr)+abs(dc) = 1 THEN 1 ELSE 0 END)*b.x) AS lap
  FROM {name}_p a JOIN {name}_z USING (scene_id), range(-1, 2) i(dr), range(-1, 2) j(dc)
  JOIN {name}_p b ON b.scene_id = a.scene_id AND b.r = {fold('a.r+dr', 'h')} AND b.c = {fold('a.c+dc', 'w')} GROUP BY ALL)"""


@query("gradient", f"WITH {_sobel_sql(sql.PX, 'vv', 'q')} SELECT scene_id, r, c, round(sqrt(gx*gx+gy*gy), 9) AS gradient FROM q")
def gradient(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.gradient(pixel_grid(spark, sf), "vv").select("scene_id", "r", "c", F.round("gradient", 9).alias("gradient"))


@query("sharpness", f"WITH {_sobel_sql(sql.PX, 'vv', 'q')} SELECT scene_id, round(least(1, var_pop(lap)*20), 6) AS sharpness FROM q GROUP BY scene_id")
def sharpness(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbourhood.laplacian(pixel_grid(spark, sf), "vv").groupBy("scene_id")
    return found.agg(F.round(F.least(F.lit(1.0), F.var_pop("laplacian") * 20), 6).alias("sharpness"))


def _summary_sql(px: str, name: str) -> str:
    """CTE ``name`` (scene_id, r, c, x): the mean of the bands, stretched."""
    return f"""{name}_m AS (SELECT scene_id, r, c, coalesce((blue+green+red+nir+swir1+swir2)/6, 0) AS x FROM ({px})),
{name}_e AS (SELECT scene_id, quantile_cont(x, .01) AS a, quantile_cont(x, .99) AS b FROM {name}_m GROUP BY 1),
{name} AS (SELECT scene_id, r, c, CASE WHEN b-a >= 1e-12 THEN greatest(0, least(1, (x-a)/(b-a))) ELSE 0 END AS x FROM {name}_m JOIN {name}_e USING (scene_id))"""


@query("gradient_ncc", f"WITH {_summary_sql(sql.BEFORE, 'sb')}, {_summary_sql(sql.AFTER, 'sa')}, {_sobel_sql('FROM sb', 'x', 'qb')}, {_sobel_sql('FROM sa', 'x', 'qa')} "
       "SELECT scene_id, round(corr(sqrt(b.gx**2+b.gy**2), sqrt(a.gx**2+a.gy**2)), 6) AS ncc FROM qb b JOIN qa a USING (scene_id, r, c) GROUP BY scene_id")  # fmt: skip
def gradient_ncc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(registration.gradient_ncc(pixel_pair(spark, sf), list(BANDS)), "ncc")


def _box7(values: str, px: str, name: str) -> str:
    fold = lambda v, top: f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > {top} THEN 2*{top}-({v}) ELSE {v} END)"
    return f"""{name}_z AS (SELECT scene_id, max(r) AS h, max(c) AS w FROM {px} GROUP BY 1),
{name} AS (SELECT a.scene_id, a.r, a.c, sum(b.{values})/49 AS m, sum(b.{values}*b.{values})/49 AS mm FROM {px} a JOIN {name}_z USING (scene_id), range(-3, 4) i(dr), range(-3, 4) j(dc)
  JOIN {px} b ON b.scene_id = a.scene_id AND b.r = {fold('a.r+dr', 'h')} AND b.c = {fold('a.c+dc', 'w')} GROUP BY ALL)"""


@query("texture", f"""WITH p AS (SELECT * FROM ({sql.PX})), me AS (SELECT scene_id, median(nir) AS m FROM p GROUP BY 1), fi AS (SELECT scene_id, r, c, coalesce(nir, m, 0) AS v FROM p JOIN me USING (scene_id)),
en AS (SELECT scene_id, quantile_cont(v, .01) AS a, quantile_cont(v, .99) AS b FROM fi GROUP BY 1), st AS (SELECT scene_id, r, c, CASE WHEN b-a >= 1e-12 THEN greatest(0, least(1, (v-a)/(b-a))) ELSE 0 END AS x FROM fi JOIN en USING (scene_id)),
{_box7('x', 'st', 'bx')}, sd AS (SELECT scene_id, r, c, sqrt(greatest(mm-m*m, 0)) AS s FROM bx), e2 AS (SELECT scene_id, quantile_cont(s, .01) AS a, quantile_cont(s, .99) AS b FROM sd GROUP BY 1)
SELECT scene_id, r, c, round(CASE WHEN b-a >= 1e-12 THEN greatest(0, least(1, (s-a)/(b-a))) ELSE 0 END, 6) AS texture FROM sd JOIN e2 USING (scene_id)""")  # fmt: skip
def texture(spark: SparkSession, sf: str) -> DataFrame:
    """Local deviation over seven pixels, reflected at the border, stretched to [0, 1]."""
    return rounded(kernels.local_deviation(pixel_grid(spark, sf), "nir", "texture").select("scene_id", "r", "c", "texture"), "texture")


def _mask(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of a total price over the 60th percentile of their scene."""
    px = pixel_grid(spark, sf)
    cut = px.groupBy("scene_id").agg(F.percentile("vv", 0.6).alias("cut"))
    return px.join(cut, "scene_id").withColumn("mask", F.col("vv") > F.col("cut"))


_MASK = f"p AS (SELECT scene_id, r, c, vv FROM ({sql.PX})), ct AS (SELECT scene_id, quantile_cont(vv, .6) AS cut FROM p GROUP BY 1), mk AS (SELECT p.*, vv > cut AS mask FROM p JOIN ct USING (scene_id)), on_ AS (SELECT * FROM mk WHERE mask)"
_COMPONENTS = f"WITH RECURSIVE {_MASK}, {sql.components('k', 'on_')}, nb AS (SELECT scene_id, r, c, dense_rank() OVER (PARTITION BY scene_id ORDER BY lab)::INT AS label FROM k_l)"


@query("connected_components", f"{_COMPONENTS} SELECT scene_id, r, c, label FROM nb")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.components(_mask(spark, sf), "mask")


@query("regions", f"""{_COMPONENTS}, bx AS (SELECT scene_id, label, count(*) AS pixel_area, min(c) AS c0, min(r) AS r0, max(c)+1 AS c1, max(r)+1 AS r1, round(avg(c), 6) AS centroid_c, round(avg(r), 6) AS centroid_r,
  round(greatest(0, least(1, avg(vv))), 6) AS score FROM nb JOIN p USING (scene_id, r, c) GROUP BY ALL HAVING count(*) >= 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY pixel_area DESC, label)::INT AS rank, count(*) OVER (PARTITION BY scene_id) > 200 AS more FROM bx)
SELECT *, pixel_area*{AREA_SQL} AS area_m2 FROM rk WHERE rank <= 200""")
def regions(spark: SparkSession, sf: str) -> DataFrame:
    px = staged(_mask(spark, sf))
    found = neighbourhood.regions(px, neighbourhood.components(px, "mask"), "vv", AREA, 4)
    return rounded(found, "score", "centroid_r", "centroid_c")


@query("clean_mask", f"WITH RECURSIVE {_MASK}, {sql.cleaned('x', 'mk', 'mask', 9)} SELECT mk.scene_id, mk.r, mk.c, x.r IS NOT NULL AS mask FROM mk LEFT JOIN x ON x.scene_id = mk.scene_id AND x.r = mk.r AND x.c = mk.c")
def clean_mask(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood.clean_masks(_mask(spark, sf).select("scene_id", "r", "c", "mask"), ["mask"], 1, 2, 9)


#: All scenes below one another: one scene that grows with the tables.
_MOSAIC = f"big AS MATERIALIZED (SELECT 0::BIGINT AS scene_id, (scene_id*{HEIGHT} + r)::INT AS r, c, mask AND c % 7 > 0 AS mask FROM mk)"
#: Edge of its tiles: scenes of 125 by 48 are cut both ways, and no cut is a scene's edge.
_TILE = 32


def _mosaic(spark: SparkSession, sf: str) -> DataFrame:
    row = (F.col("scene_id") * HEIGHT + F.col("r")).cast("int")
    return _mask(spark, sf).select(F.lit(0).cast("long").alias("scene_id"), row.alias("r"), "c", (F.col("mask") & (F.col("c") % 7 > 0)).alias("mask"))


@query("mosaic_components", f"WITH RECURSIVE {_MASK}, {_MOSAIC}, big_on AS (SELECT * FROM big WHERE mask), {sql.components('k', 'big_on')} SELECT scene_id, r, c, dense_rank() OVER (ORDER BY lab)::INT AS label FROM k_l")
def mosaic_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of one scene that is many tiles."""
    return mosaic.components(_mosaic(spark, sf), "mask", _TILE)


@query("mosaic_clean_mask", f"WITH RECURSIVE {_MASK}, {_MOSAIC}, {sql.cleaned('x', 'big', 'mask', 9)} SELECT big.scene_id, big.r, big.c, x.r IS NOT NULL AS mask FROM big LEFT JOIN x USING (scene_id, r, c)")
def mosaic_clean_mask(spark: SparkSession, sf: str) -> DataFrame:
    """That scene's mask, cleaned tile by tile."""
    return mosaic.clean_masks(_mosaic(spark, sf), ["mask"], 1, 2, 9, _TILE)


@query("sector_counts", f"WITH p AS (SELECT scene_id, r, c, vv, max(r) OVER (PARTITION BY scene_id) + 1 AS h, max(c) OVER (PARTITION BY scene_id) + 1 AS w FROM ({sql.PX})), " + "s(sector, r0, r1, c0, c1) AS (VALUES ('north', 0.0, 0.5, 0.0, 1.0), ('south', 0.5, 1.0, 0.0, 1.0), ('east', 0.0, 1.0, 0.5, 1.0), ('west', 0.0, 1.0, 0.0, 0.5), "
       "('north_east', 0.0, 0.5, 0.5, 1.0), ('north_west', 0.0, 0.5, 0.0, 0.5), ('south_east', 0.5, 1.0, 0.5, 1.0), ('south_west', 0.5, 1.0, 0.0, 0.5), ('centre', 0.25, 0.75, 0.25, 0.75)) "
       "SELECT scene_id, sector, count(*) AS pixels, round(avg(vv), 6) AS mean FROM p JOIN s ON r >= round_even(r0*h, 0) AND r < round_even(r1*h, 0) AND c >= round_even(c0*w, 0) AND c < round_even(c1*w, 0) GROUP BY scene_id, sector")  # fmt: skip
def sector_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of each named part of the frame; bounds are rounded half to even."""
    px = pixel_grid(spark, sf).select("scene_id", "r", "c", "vv")
    placed = px.join(grounding.frames(px), "scene_id").withColumn("sector", F.explode(F.array(*map(F.lit, grounding.SECTORS))))
    placed = placed.where(grounding.in_sector(F.col("sector")))
    return placed.groupBy("scene_id", "sector").agg(F.count("*").alias("pixels"), F.round(F.avg("vv"), 6).alias("mean"))


@query("code_dimension", f"WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)} SELECT class_code::INT AS class_code, {_NAME.format('class_code')} AS class, count(*) AS n FROM lc GROUP BY class_code")
def code_dimension(spark: SparkSession, sf: str) -> DataFrame:
    lc = landcover.classify(pixel_grid(spark, sf, fields=True), list(BANDS))
    return lc.groupBy("class_code").agg(F.count("*").alias("n")).select("class_code", landcover.code_name(F.col("class_code")).alias("class"), "n")


@query("truth_counts", f"{_PAIR} SELECT scene_id, {_NAME.format('cb')} AS before, {_NAME.format('ca')} AS after, count(*) AS n FROM pr GROUP BY scene_id, cb, ca")
def truth_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of each pair of classes of two class maps, unchanged ones too."""
    names = [landcover.code_name(F.col(f"class_code_{d}")).alias(n) for d, n in (("b", "before"), ("a", "after"))]
    return _pair(spark, sf).groupBy("scene_id", *names).agg(F.count("*").alias("n"))


@query("class_separability", f"WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)}, ix AS (SELECT *, {sql.INDICES['ndwi']} AS ndwi FROM lc), sp AS (" + " UNION ALL ".join(
    f"SELECT scene_id, CASE WHEN count({i}) FILTER (class_code = {k}) < 8 OR count({i}) FILTER (class_code <> {k}) < 8 THEN 0.0 WHEN sqrt(.5*(var_pop({i}) FILTER (class_code = {k}) + var_pop({i}) FILTER (class_code <> {k}))) < 1e-9 "
    f"THEN CASE WHEN abs(avg({i}) FILTER (class_code = {k}) - avg({i}) FILTER (class_code <> {k})) > 1e-9 THEN 1.0 ELSE 0.0 END ELSE least(1.0, abs(avg({i}) FILTER (class_code = {k}) - avg({i}) FILTER (class_code <> {k}))"
    f"/sqrt(.5*(var_pop({i}) FILTER (class_code = {k}) + var_pop({i}) FILTER (class_code <> {k})))/2) END AS s FROM ix GROUP BY scene_id HAVING count(*) FILTER (class_code = {k}) > 0" for i, k in (("ndwi", 1), ("ndvi", 2), ("ndbi", 3)))
    + ") SELECT scene_id, round(coalesce(avg(s), 0), 6) AS separability FROM (SELECT DISTINCT scene_id FROM lc) LEFT JOIN sp USING (scene_id) GROUP BY scene_id")
def class_separability(spark: SparkSession, sf: str) -> DataFrame:
    lc = staged(landcover.with_indices(landcover.classify(pixel_grid(spark, sf, fields=True), list(BANDS)), ["ndwi"]))
    return rounded(landcover.mean_separability(lc, ["ndwi", "mndwi", "ndvi", "ndbi"]), "separability")
