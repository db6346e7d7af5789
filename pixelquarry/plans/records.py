"""Queries on geometry, evaluation, confidence and stored records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.operators import answers, confidence, contracts, geometry, metrics, probe, registration
from pixelquarry.operators.staging import shared_folder
from pixelquarry.operators.wording import filled_sql
from pixelquarry.sources import allocation, geotiff
from pixelquarry.sources.scenes import read
from pixelquarry.sources.sinks import RecordStore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """One scene for each supplier: a footprint, a size and an affine from its key."""
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(
        k.alias("scene_id"), (k * 37 % 997).cast("double").alias("minx"), (k * 61 % 991).cast("double").alias("miny"),
        (k % 4096 + 200).cast("int").alias("width"), (k * 7 % 3000 + 100).cast("int").alias("height"), (k % 3 != 0).alias("has_crs"), (k % 5 == 0).alias("rotated"),
    )
    return rows.withColumns({"maxx": F.col("minx") + 40, "maxy": F.col("miny") + 30})


_SC = """sc AS (SELECT s_suppkey AS scene_id, (s_suppkey*37 % 997)::DOUBLE AS minx, (s_suppkey*61 % 991)::DOUBLE AS miny, (s_suppkey % 4096 + 200)::INT AS width, (s_suppkey*7 % 3000 + 100)::INT AS height,
  s_suppkey % 3 <> 0 AS has_crs, s_suppkey % 5 = 0 AS rotated FROM supplier), sb AS (SELECT *, minx + 40 AS maxx, miny + 30 AS maxy FROM sc)"""


@query("decimated_shape", f"WITH {_SC}, f AS (SELECT *, CASE WHEN greatest(width, height) <= 1024 THEN 1.0 ELSE greatest(width, height)/1024.0 END::DOUBLE AS factor FROM sc) "
       "SELECT scene_id, round(factor, 6) AS factor, greatest(1, round_even(width/factor, 0)::INT) AS out_width, greatest(1, round_even(height/factor, 0)::INT) AS out_height FROM f")  # fmt: skip
def decimated_shape(spark: SparkSession, sf: str) -> DataFrame:
    factor, w, h = geometry.decimated(F.col("width"), F.col("height"), 1024)
    return scenes(spark, sf).select("scene_id", F.round(factor, 6).alias("factor"), w.alias("out_width"), h.alias("out_height"))


def _affine() -> tuple:
    t = [F.lit(10.0), F.when(F.col("rotated"), 0.5).otherwise(0.0), F.col("minx"), F.when(F.col("rotated"), 0.5).otherwise(0.0), F.lit(-10.0), F.col("maxy")]
    return F.when(F.col("has_crs"), 32643), t


@query("grid_flags", f"WITH {_SC} SELECT scene_id, has_crs AS georeferenced, has_crs AND NOT rotated AS north_up, round(sqrt(100 + CASE WHEN rotated THEN 0.25 ELSE 0 END), 6) AS pixel_width, "
       "round((CASE WHEN has_crs THEN 100 + CASE WHEN rotated THEN 0.25 ELSE 0 END END)::DOUBLE, 6) AS pixel_area, round(width*height/1e6, 6) AS megapixels FROM sb")  # fmt: skip
def grid_flags(spark: SparkSession, sf: str) -> DataFrame:
    epsg, t = _affine()
    return scenes(spark, sf).select(
        "scene_id", geometry.is_georeferenced(epsg, t).alias("georeferenced"), geometry.is_north_up(epsg, t).alias("north_up"), F.round(geometry.pixel_size(t)[0], 6).alias("pixel_width"),
        F.round(geometry.pixel_area(epsg, t, F.lit(1.0)), 6).alias("pixel_area"), F.round(F.col("width") * F.col("height") / 1e6, 6).alias("megapixels"),
    )


@query("min_patch_pixels", f"WITH {_SC} SELECT scene_id, least(CASE WHEN has_crs THEN greatest(1, round_even(2500/(100 + CASE WHEN rotated THEN 0.25 ELSE 0 END), 0)) ELSE 25 END, greatest(1, floor(width*height*0.25)))::BIGINT AS pixels FROM sb")
def min_patch_pixels(spark: SparkSession, sf: str) -> DataFrame:
    epsg, t = _affine()
    wanted = geometry.pixels_for_area(F.lit(2500.0), geometry.pixel_area(epsg, t, F.lit(1.0)), 25, F.col("width") * F.col("height"))
    return scenes(spark, sf).select("scene_id", wanted.alias("pixels"))


@query("bbox_to_geo", f"WITH {_SC}, t AS (SELECT *, CASE WHEN rotated THEN 0.5 ELSE 0 END AS b FROM sb) SELECT scene_id, round(minx + 10*5 + b*7, 6) AS x0, round(maxy + b*5 - 10*(7+20), 6) AS y0, round(minx + 10*(5+30) + b*(7+20), 6) AS x1, round(maxy + b*(5+30) - 10*7, 6) AS y1 FROM t")
def bbox_to_geo(spark: SparkSession, sf: str) -> DataFrame:
    box = geometry.bbox_to_geo(_affine()[1], F.lit(5), F.lit(7), F.lit(35), F.lit(27))
    return scenes(spark, sf).select("scene_id", *[F.round(x, 6).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), box)])


_OV = f"""WITH {_SC}, o AS (SELECT a.scene_id AS "left", b.scene_id AS "right", greatest(0, least(a.maxx, b.maxx)-greatest(a.minx, b.minx))*greatest(0, least(a.maxy, b.maxy)-greatest(a.miny, b.miny))/1200.0 AS overlap,
  a.has_crs AND b.has_crs AS geo FROM sb a JOIN sb b ON a.scene_id < b.scene_id AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy)"""


@query("footprint_overlap", f'{_OV} SELECT "left", "right", round(overlap, 6) AS overlap FROM o WHERE overlap > 0')
def footprint_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.overlapping(scenes(spark, sf), 50.0).select("left", "right", F.round("overlap", 6).alias("overlap"))


@query("pair_strategy", f"""{_OV}, p AS (SELECT o.*, a.epsg = b.epsg AS same_crs, a.epsg = b.epsg AND a.width = b.width AND a.height = b.height AS same_grid FROM o JOIN sg a ON a.scene_id = o."left" JOIN sg b ON b.scene_id = o."right")
SELECT "left", "right", CASE WHEN NOT geo THEN 'pixel_assume' WHEN overlap < 0.3 THEN 'incompatible' WHEN NOT same_crs THEN 'reproject' WHEN same_grid THEN 'identical_grid' ELSE 'resample' END AS strategy,
  CASE WHEN geo AND overlap >= 0.3 AND overlap < 0.98 THEN 'partial_overlap' WHEN NOT geo THEN 'not_georeferenced' END AS warning FROM p WHERE overlap > 0""".replace("WITH sc AS", "WITH sg AS (SELECT s_suppkey AS scene_id, 32643 + s_suppkey % 2 AS epsg, (s_suppkey // 4) % 2 AS width, (s_suppkey // 8) % 2 AS height FROM supplier), sc AS", 1))  # fmt: skip
def pair_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of scenes in one of two reference systems and one of four shapes."""
    s = scenes(spark, sf)
    k = F.col("scene_id")
    grids = s.select("scene_id", "has_crs", (32643 + k % 2).alias("epsg"), (F.floor(k / 4) % 2).alias("w"), (F.floor(k / 8) % 2).alias("h"))
    pairs = geometry.overlapping(s, 50.0)
    for side in ("left", "right"):
        pairs = pairs.join(grids.select(F.col("scene_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("has_crs", "epsg", "w", "h")]), side)
    same = lambda c: F.col("left_" + c) == F.col("right_" + c)
    both = F.col("left_has_crs") & F.col("right_has_crs")
    strategy = geometry.pair_strategy(both, F.col("overlap"), same("epsg"), same("epsg") & same("w") & same("h"))
    return pairs.select("left", "right", strategy.alias("strategy"), geometry.pair_warning(both, F.col("overlap")).alias("warning"))


@query("mask_metrics", "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn FROM labels) "
       "SELECT *, round(tp/nullif(tp+fp, 0)::DOUBLE, 6) AS precision, round(tp/nullif(tp+fn, 0)::DOUBLE, 6) AS recall, round(2*tp/nullif(2*tp+fp+fn, 0)::DOUBLE, 6) AS f1, round(tp/nullif(tp+fp+fn, 0)::DOUBLE, 6) AS iou, round(2*tp/nullif(2*tp+fp+fn, 0)::DOUBLE, 6) AS dice FROM c")  # fmt: skip
def mask_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.mask_metrics(read(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "iou", "dice")})


def _boxes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """True boxes and found ones of a sample: one of each for every order of a customer, from its keys."""
    k = F.col("o_orderkey")
    box = lambda x, y, w, h: F.array(*[v.cast("double") for v in (x, y, x + w, y + h)])
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("sample"), k.alias("id"), (k % 29).alias("x"), (k % 31).alias("y"), (k % 11 + 4).alias("w"), (k % 7 + 4).alias("h"))
    truth = rows.select("sample", "id", box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    found = rows.select("sample", "id", box(F.col("x") + F.col("id") % 3, F.col("y") - F.col("id") % 2, F.col("w") + F.col("id") % 5, F.col("h")).alias("box"))
    return truth, found.where("id % 6 != 0")


_BOXES = """WITH b AS (SELECT o_custkey AS sample, o_orderkey AS id, (o_orderkey % 29)::DOUBLE AS x, (o_orderkey % 31)::DOUBLE AS y, o_orderkey % 11 + 4 AS w, o_orderkey % 7 + 4 AS h FROM orders),
t AS (SELECT sample, id, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM b), f AS (SELECT sample, id, x + id % 3 AS x0, y - id % 2 AS y0, x + id % 3 + w + id % 5 AS x1, y - id % 2 + h AS y1 FROM b WHERE id % 6 <> 0),
v AS (SELECT t.sample, t.id AS ti, f.id AS fi, greatest(0, least(t.x1, f.x1)-greatest(t.x0, f.x0))*greatest(0, least(t.y1, f.y1)-greatest(t.y0, f.y0)) AS s, (t.x1-t.x0)*(t.y1-t.y0) AS ta, (f.x1-f.x0)*(f.y1-f.y0) AS fa FROM t LEFT JOIN f USING (sample)),
i AS (SELECT sample, ti, fi, coalesce(s/(ta+fa-s), 0) AS iou FROM v)"""


@query("box_iou", f"{_BOXES} SELECT sample, ti, fi, round(iou, 6) AS iou FROM i WHERE fi IS NOT NULL")
def box_iou(spark: SparkSession, sf: str) -> DataFrame:
    truth, found = _boxes(spark, sf)
    pairs = truth.select("sample", F.col("id").alias("ti"), F.col("box").alias("a")).join(found.select("sample", F.col("id").alias("fi"), F.col("box").alias("b")), "sample")
    iou = metrics.box_iou(*[[F.element_at(F.col(n), k) for k in (1, 2, 3, 4)] for n in "ab"])
    return pairs.select("sample", "ti", "fi", F.round(iou, 6).alias("iou"))


@query("best_boxes", f"{_BOXES}, bt AS (SELECT sample, ti, max(iou) AS iou FROM i GROUP BY 1, 2), bf AS (SELECT sample, fi, max(iou) AS iou FROM i WHERE fi IS NOT NULL GROUP BY 1, 2) "
       "SELECT sample, round(best, 6) AS best, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (SELECT sample, avg(iou) AS best, avg((iou >= .5)::INT) AS recall FROM bt GROUP BY 1) LEFT JOIN (SELECT sample, avg((iou >= .5)::INT) AS precision FROM bf GROUP BY 1) USING (sample)")  # fmt: skip
def best_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_boxes(*_boxes(spark, sf), ["sample"]).select("sample", *[F.round(c, 6).alias(c) for c in ("best", "precision", "recall")])


_ANSWERS = "SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_name) WHEN 1 THEN p_name || ' ' WHEN 2 THEN p_name || '.' ELSE NULL END AS b FROM part"


@query("exact_match", f"SELECT p_partkey, coalesce(lower(trim(a)) = lower(trim(b)), false) AS matched FROM ({_ANSWERS})")
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, F.concat(F.lit("  "), F.upper(name))).when(k == 1, F.concat(name, F.lit(" "))).when(k == 2, F.concat(name, F.lit(".")))
    return read(spark, sf, "part").select("p_partkey", metrics.exact_match(name, other).alias("matched"))


def _head(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with their ranked classes, by a head made of the vectors with an even identifier."""
    rows = read(spark, sf, "embeddings")
    return metrics.linear_head(rows, "embedding", metrics.class_means(rows.where("vec_id % 2 = 0"), "embedding", "label"), "label")


_HEAD = """WITH m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id % 2 = 0) GROUP BY 1, 2),
w AS (SELECT label AS name, list(x ORDER BY i) AS w, -sum(x*x)/2 AS b FROM m GROUP BY 1),
s AS (SELECT vec_id, label, name, list_inner_product(w, embedding::DOUBLE[]) + b AS s FROM embeddings, w), q AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s),
p AS (SELECT vec_id, label, name, e/sum(e) OVER (PARTITION BY vec_id) AS p FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, name) AS k FROM p), pr AS (SELECT label, name AS predicted FROM r WHERE k = 1)"""


@query("confusion_matrix", f"{_HEAD} SELECT label, predicted, count(*) AS n FROM pr GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_head(spark, sf).withColumn("predicted", F.col("ranked")[0]["name"]), "label", "predicted")


@query("class_accuracy", f"{_HEAD} SELECT label, count(*) AS n, round(avg((label = predicted)::INT), 6) AS accuracy FROM pr GROUP BY 1")
def class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = _head(spark, sf).withColumn("predicted", F.col("ranked")[0]["name"])
    return metrics.class_accuracy(rows, "label", "predicted").withColumn("accuracy", F.round("accuracy", 6))


@query("scene_head", f"{_HEAD} SELECT vec_id, max(name) FILTER (k = 1) AS best, round(max(p) FILTER (k = 1), 6) AS probability, round(max(p) FILTER (k = 1) - coalesce(max(p) FILTER (k = 2), 0), 6) AS margin FROM r GROUP BY 1")
def scene_head(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked class probabilities of a linear head over whole supplied vectors."""
    top, second = F.col("ranked")[0], F.try_element_at("ranked", F.lit(2))
    margin = top["probability"] - F.coalesce(second["probability"], F.lit(0.0))
    return _head(spark, sf).select("vec_id", top["name"].alias("best"), F.round(top["probability"], 6).alias("probability"), F.round(margin, 6).alias("margin"))


@query("linear_probe")
def linear_probe(spark: SparkSession, sf: str) -> DataFrame:
    """The confusion of a probe that is trained on the vectors with an even identifier, over the others."""
    rows = read(spark, sf, "embeddings")
    return metrics.confusion(probe.train_probe(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), "embedding", "label", "vec_id"), "label", "predicted")


_SCENE = {"name": "name", "share": "round(p*100)::BIGINT || '%'"}


@query("scene_sentence", f"{_HEAD} SELECT vec_id, CASE WHEN p >= 0.5 THEN {filled_sql('scene.sure', **_SCENE)} ELSE {filled_sql('scene.unsure', **_SCENE)} END AS answer FROM r WHERE k = 1")
def scene_sentence(spark: SparkSession, sf: str) -> DataFrame:
    ranked = F.transform("ranked", lambda x: F.struct(x["name"].cast("string").alias("name"), x["probability"].alias("probability")))
    return _head(spark, sf).select("vec_id", answers.scene_sentence(ranked).alias("answer"))


@query("stratified_split", "SELECT lang, n, (floor(n*0.7))::BIGINT AS train, (floor(n*(0.7+0.15)) - floor(n*0.7))::BIGINT AS validation, (n - floor(n*(0.7+0.15)))::BIGINT AS test, n AS documents FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a split, and how many different documents its parts hold together."""
    split = metrics.stratified_split(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.7, 0.15)
    count = lambda s: F.count_if(F.col("split") == s).alias(s)
    return split.groupBy("lang").agg(F.count("*").alias("n"), count("train"), count("validation"), count("test"), F.count_distinct("doc_id").alias("documents"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda m, n: (k * m % n) / F.lit(float(n))
    return read(spark, sf, "orders").select(
        k.alias("request_id"), part(13, 101).alias("bimodality"), part(17, 97).alias("corroborated"), part(19, 89).alias("registration"), part(23, 83).alias("threshold_quality"),
        part(29, 79).alias("separability"), part(31, 73).alias("agreement"), F.when(k % 4 != 0, part(7, 71)).alias("prominence"), (part(11, 67) * 3).alias("speckle_reduction"), (k % 5).alias("n_warnings"),
        F.when(k % 3 != 0, part(37, 61)).alias("quality"), F.when(k % 7 != 0, part(41, 59)).alias("attribution"), part(43, 53).alias("probability"), part(47, 51).alias("margin"),
        F.when(k % 2 == 0, part(5, 49)).alias("test_accuracy"), (k % 2 == 0).alias("count_reportable"),
    )


_RES = "rs AS (SELECT o_orderkey AS request_id, " + ", ".join(f"(o_orderkey*{m} % {n})/{n}.0::DOUBLE AS {x}" for x, m, n in (("bimodality", 13, 101), ("corroborated", 17, 97), ("registration", 19, 89), ("threshold_quality", 23, 83), ("separability", 29, 79), ("agreement", 31, 73))) + \
    ", CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey*7 % 71)/71.0::DOUBLE END AS prominence, (o_orderkey*11 % 67)/67.0::DOUBLE*3 AS speckle_reduction, o_orderkey % 5 AS n_warnings, " + ", ".join(f"CASE WHEN {c} THEN (o_orderkey*{m} % {n})/{n}.0::DOUBLE END AS {x}" for x, m, n, c in (("quality", 37, 61, "o_orderkey % 3 <> 0"), ("attribution", 41, 59, "o_orderkey % 7 <> 0"), ("probability", 43, 53, "true"), ("margin", 47, 51, "true"), ("test_accuracy", 5, 49, "o_orderkey % 2 = 0"))) + \
    ", o_orderkey % 2 = 0 AS count_reportable FROM orders)"
_WARN = "greatest(1 - 0.15*n_warnings, 0.4)"


def _factor_rows(factors: list[tuple[str, str, float, bool]]) -> str:
    """CTE fa: the factors whose value is known, in order."""
    rows = " UNION ALL ".join(f"SELECT request_id, '{n}' AS name, ({v})::DOUBLE AS raw, {w}::DOUBLE AS weight, {str(g).upper()} AS gate, {i} AS ord FROM rs" for i, (n, v, w, g) in enumerate(factors))
    return f"WITH {_RES}, fa AS (SELECT *, greatest(0, least(1, raw)) AS value FROM ({rows}) WHERE raw IS NOT NULL)"


def _conf(factors: list[tuple[str, str, float, bool]]) -> str:
    return f"""{_factor_rows(factors)}, ag AS (SELECT request_id, sum(value*weight)/sum(weight) AS mean, min(value) FILTER (gate) AS gate,
  arg_min(name, (value, ord)) FILTER (gate) AS gn, arg_min(name, (value, ord)) FILTER (weight > 0) AS ln FROM fa GROUP BY 1), sc AS (SELECT *, least(mean, coalesce(gate, mean)) AS score FROM ag)
SELECT request_id, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.25 THEN 'low' ELSE 'insufficient' END AS level,
  CASE WHEN gate < mean THEN gn ELSE ln END AS limiting_factor FROM sc"""


_SHARED = [("warnings", _WARN, 0.1, False), ("input_quality", "quality", 0.25, False)]
_CONFIDENCE = {
    "change": (confidence.for_change, [("evidence_strength", "least(greatest(0, least(1, (bimodality - 1/3.0::DOUBLE)/(5/9.0::DOUBLE - 1/3.0::DOUBLE))), corroborated)", 0.45, True), ("registration", "registration", 0.2, True), ("threshold_quality", "threshold_quality", 0.25, False), ("semantic_attribution", "attribution", 0.15, False), *_SHARED]),
    "landcover": (confidence.for_landcover, [("class_separability", "separability", 0.45, True), *_SHARED]),
    "sar": (confidence.for_sar, [("regime_separation", "coalesce(least(prominence/0.5, 1), 0.6)", 0.45, False), ("speckle_reduction", "least(speckle_reduction/2, 1)", 0.2, False), *_SHARED]),
    "fusion": (confidence.for_fusion, [("corroboration", "corroborated", 0.45, True), ("sensor_agreement", "agreement", 0.25, False), ("registration", "registration", 0.2, False), *_SHARED]),
    "grounding": (confidence.for_grounding, [("class_separability", "separability", 0.45, True), _SHARED[0], ("count_reportable", "CASE WHEN NOT count_reportable THEN 1 END", 0.0, False), _SHARED[1]]),
    "scene": (confidence.for_scene, [("model_probability", "probability", 0.45, True), ("model_margin", "margin", 0.15, False), _SHARED[0], ("model_test_accuracy", "test_accuracy", 0.15, False), ("class_separability", "separability", 0.2, False), _SHARED[1]]),
}
for _name, (_for, _factors) in _CONFIDENCE.items():

    def _scored(spark: SparkSession, sf: str, build=_for) -> DataFrame:
        rows = _results(spark, sf)
        return confidence.assessed(rows, build(rows)).select("request_id", F.round("score", 6).alias("score"), "level", "limiting_factor")

    QUERIES[f"confidence_{_name}"], SQL[f"confidence_{_name}"] = _scored, _conf(_factors)


_REASON = "CASE name WHEN 'count_reportable' THEN 'the number of regions is withheld' ELSE replace(name, '_', ' ') || ' scored ' || printf('%.2f', round(raw, 2)) END"


@query("confidence_reasons", f"{_factor_rows(_CONFIDENCE['grounding'][1])} SELECT request_id, string_agg({_REASON}, '; ' ORDER BY value, ord) AS reasons FROM fa GROUP BY 1")
def confidence_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a grounding is as sure as it is, the weakest factor first."""
    rows = _results(spark, sf)
    return confidence.assessed(rows, confidence.for_grounding(rows)).select("request_id", F.array_join("reasons", "; ").alias("reasons"))


@query("evidence_items", f"{_factor_rows(_CONFIDENCE['change'][1])}, ob AS (SELECT request_id, unnest(['first line', 'warnings: ' || n_warnings]) AS description, unnest([0, 1]) AS ord FROM rs) "
       f"SELECT request_id, ord::INT AS ord, 'observation' AS type, 'change' AS source, NULL::DOUBLE AS value, description FROM ob UNION ALL SELECT request_id, (2 + row_number() OVER (PARTITION BY request_id ORDER BY ord) - 1)::INT, CASE WHEN gate THEN 'quality' ELSE 'measurement' END, 'change:' || name, round(value, 6), {_REASON} FROM fa")  # fmt: skip
def evidence_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = _results(spark, sf)
    lines = F.array(F.lit("first line"), F.concat(F.lit("warnings: "), F.col("n_warnings").cast("string")))
    items = rows.select("request_id", F.posexplode(confidence.evidence(lines, F.lit("change"), confidence.for_change(rows))).alias("ord", "e"))
    return items.select("request_id", "ord", "e.type", "e.source", F.round("e.value", 6).alias("value"), "e.description")


_GATE = "(o_orderkey*13 % 41)/10.0::DOUBLE AS offset_px, (o_orderkey*17 % 100)/100.0::DOUBLE AS ncc, (o_orderkey*19 % 90)/90.0::DOUBLE AS response"


@query("registration_gate", f"WITH g AS (SELECT o_orderkey AS request_id, {_GATE} FROM orders), s AS (SELECT *, greatest(0, least(1, .5*greatest(0, 1-offset_px/10) + .35*greatest(ncc, 0) + .15*response)) AS score FROM g), "
       "r AS (SELECT *, concat_ws(',', CASE WHEN offset_px > 2 THEN 'offset' END, CASE WHEN ncc < .35 THEN 'structure' END, CASE WHEN score < .45 THEN 'score' END) AS reasons FROM s) SELECT request_id, round(score, 6) AS score, reasons = '' AS passed, reasons FROM r")  # fmt: skip
def registration_gate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(k.alias("request_id"), (k * 13 % 41 / 10.0).alias("offset"), (k * 17 % 100 / 100.0).alias("ncc"), (k * 19 % 90 / 90.0).alias("response"))
    rows = rows.withColumn("score", confidence.registration_score(F.col("offset"), F.col("ncc"), F.col("response")))
    gate = registration.gate(F.col("offset"), F.col("ncc"), F.col("score"))
    return rows.withColumns(gate).select("request_id", F.round("score", 6).alias("score"), "passed", F.array_join("reasons", ",").alias("reasons"))


@query("ordered_warnings", "SELECT o_orderkey AS request_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l)+1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]), ',') AS warnings FROM "
       "(SELECT o_orderkey, [o_orderstatus, o_orderpriority[1:1], o_orderstatus, 'w' || o_orderkey % 3, o_orderpriority[1:1], 'w1'] AS l FROM orders)")  # fmt: skip
def ordered_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings of three steps, each once."""
    rank = F.substring("o_orderpriority", 1, 1)
    lists = (F.array("o_orderstatus", rank), F.array(F.col("o_orderstatus"), F.concat(F.lit("w"), (F.col("o_orderkey") % 3).cast("string"))), F.array(rank, F.lit("w1")))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.array_join(confidence.distinct_in_order(*lists), ",").alias("warnings"))


@query("history", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def history(spark: SparkSession, sf: str) -> DataFrame:
    """The newest twenty records: a report whose length is the feature."""
    return read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type")


@query("record_lookup", "SELECT o_orderkey AS request_id, c_name, CASE WHEN c_custkey IS NULL THEN 'IMAGE_NOT_FOUND' END AS error_code FROM orders LEFT JOIN customer ON o_custkey + o_orderkey % 2 * 1000000007 = c_custkey")
def record_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every second order asks for a record that isn't stored."""
    asked = F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000_007
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), asked == F.col("c_custkey"), "left")
    return rows.select(F.col("o_orderkey").alias("request_id"), "c_name", F.when(F.col("c_custkey").isNull(), "IMAGE_NOT_FOUND").alias("error_code"))


@query("stored_analyses", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey % 2, o_orderdate, o_orderkey) AS n FROM orders) "
       "SELECT o_orderkey AS request_id, printf('SAT-%d-%06d', year(o_orderdate), n) AS id, c_name AS image FROM b LEFT JOIN customer ON o_custkey = c_custkey")  # fmt: skip
def stored_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as analyses in two batches, customers as the images they are of: what both stores hold then."""
    folder = f"{shared_folder(spark)}/stores-{uuid.uuid4().hex}"
    images, analyses = (RecordStore(spark, f"{folder}/{name}") for name in ("images", "analyses"))
    images.append(read(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("image")))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("image_id"), F.col("o_orderdate").alias("created_at"))
    for batch in (0, 1):
        analyses.add(rows.where(F.col("request_id") % 2 == batch))
    return analyses.all().join(images.all(), "image_id", "left").select("request_id", "id", "image")


@query("next_record_id", "SELECT printf('SAT-%d-%06d', year(ts), max(event_id) + 1) AS id FROM events GROUP BY year(ts)")
def next_record_id(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "events").groupBy(F.year("ts").alias("year")).agg((F.max("event_id") + 1).alias("n"))
    return n.select(allocation.record_id(F.col("year"), F.col("n")).alias("id"))


@query("terminal_status", f"WITH {_RES} SELECT request_id, CASE WHEN separability < 0.25 OR n_warnings > 0 THEN 'partial' ELSE 'success' END AS status FROM rs")
def terminal_status(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).select("request_id", confidence.status(F.col("separability") < 0.25, F.col("n_warnings")).alias("status"))


_SENSORS = ("optical", "sar", "unknown")
_IMAGES = "im AS (SELECT event_id AS request_id, list_transform(range(event_id % 4), lambda i: ['optical', 'sar', 'unknown'][1 + (event_id // (4 * 3**i)::BIGINT) % 3]) AS modalities, event_id % 7 <> 3 AS compatible FROM events)"
_MODE = f"""{_IMAGES}, md AS (SELECT *, CASE WHEN len(modalities) = 0 THEN 'missing_image' WHEN len(modalities) > 2 THEN 'too_many_images' WHEN len(modalities) = 2 AND NOT compatible THEN 'pair_incompatible' END AS error FROM im),
mo AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN len(modalities) = 1 THEN CASE WHEN list_contains(modalities, 'sar') THEN 'single_sar' ELSE 'single_optical' END
  WHEN list_contains(modalities, 'sar') AND list_contains(modalities, 'optical') THEN 'optical_sar_pair' ELSE 'bitemporal_pair' END AS mode FROM md)"""


def _image_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with none to three images of any sensor, in a mode if they have one."""
    e = F.col("event_id")
    sensors = F.array(*map(F.lit, _SENSORS))
    sensor = lambda i: F.element_at(sensors, (1 + F.floor(e / (4 * 3**i)) % 3).cast("int"))
    rows = read(spark, sf, "events").select(e.alias("request_id"), F.slice(F.array(*[sensor(i) for i in range(3)]), F.lit(1), (e % 4).cast("int")).alias("modalities"), (e % 7 != 3).alias("compatible"))
    return rows.withColumns(contracts.input_mode(F.col("modalities"), F.col("compatible")))


@query("input_mode", f"WITH {_MODE} SELECT request_id, mode, error, array_to_string(CASE WHEN mode = 'bitemporal_pair' THEN list_filter([1, 2], lambda i: modalities[i] = 'unknown') ELSE [] END, ',') AS undetermined FROM mo")
def input_mode(spark: SparkSession, sf: str) -> DataFrame:
    unknown = contracts.undetermined(F.col("modalities"), F.col("mode"))
    return _image_sets(spark, sf).select("request_id", "mode", "error", F.array_join(F.transform(unknown, lambda k: k.cast("string")), ",").alias("undetermined"))


@query("modality_check", f"WITH {_IMAGES}, x AS (SELECT request_id, modalities[1] AS found, ['optical', 'sar', 'unknown'][1 + (request_id // 5) % 3] AS expected FROM im WHERE len(modalities) > 0) "
       "SELECT request_id, CASE WHEN expected = 'unknown' OR found = expected THEN NULL WHEN found = 'unknown' THEN 'undetermined' ELSE 'mismatch' END AS warning FROM x")  # fmt: skip
def modality_check(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.element_at(F.array(*map(F.lit, _SENSORS)), (1 + F.floor(F.col("request_id") / 5) % 3).cast("int"))
    rows = _image_sets(spark, sf).where(F.size("modalities") > 0)
    return rows.select("request_id", contracts.modality_warning(F.col("modalities")[0], expected).alias("warning"))


#: Tasks that requests ask for in turn, one of them unknown.
_ASKED = (*sorted({t[1] for t in contracts.TOOLS}), *contracts.NOT_BUILT, "report_generation")
_TOOL_ROWS = ", ".join(f"('{t}', '{task}', {tier}, {lo}, {hi}, {list(modes)}::VARCHAR[], {list(needs)}::VARCHAR[], {k})" for k, (t, task, tier, lo, hi, modes, needs) in enumerate(contracts.TOOLS))


@query("tool_dispatch", f"""WITH {_MODE}, tl(tool, task, tier, lo, hi, modes, needs, ord) AS (VALUES {_TOOL_ROWS}), rq AS (SELECT request_id, modalities, mode, {list(_ASKED)}[1 + (request_id // 3) % {len(_ASKED)}] AS task FROM mo WHERE error IS NULL),
x AS (SELECT rq.*, tool, tier, ord, tool <> 'scene-model' AS ok, CASE WHEN len(modalities) < lo THEN 'too_few_images' WHEN len(modalities) > hi THEN 'too_many_images' WHEN NOT list_contains(modes, mode) THEN 'wrong_mode' WHEN NOT list_has_all(modalities, needs) THEN 'missing_modality' END AS broken FROM rq LEFT JOIN tl USING (task)),
g AS (SELECT request_id, any_value(task) AS task, arg_min(tool, (tier, ord)) FILTER (ok AND broken IS NULL) AS tool, arg_min(broken, (list_position({list(contracts.PRIORITY)}, broken), tier, ord)) FILTER (ok AND broken IS NOT NULL) AS broken, count(tool) AS known, count(*) FILTER (ok) AS n FROM x GROUP BY 1)
SELECT request_id, tool, CASE WHEN tool IS NOT NULL THEN NULL WHEN task IN {contracts.NOT_BUILT} THEN 'unsupported_task' WHEN known = 0 THEN 'not_dispatchable' WHEN n = 0 THEN 'model_unavailable' ELSE broken END AS error FROM g""")
def tool_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Who serves each request while the scene model is out."""
    task = F.element_at(F.array(*map(F.lit, _ASKED)), (1 + F.floor(F.col("request_id") / 3) % len(_ASKED)).cast("int"))
    rows = _image_sets(spark, sf).where("error IS NULL").select("request_id", "modalities", "mode", task.alias("task"))
    return contracts.dispatch(rows, ("scene-model",))


#: When a tool fails: the scene model for every third request, land cover for every seventh.
_FAILS = "((tool = 'scene-model' AND request_id % 3 = 0) OR (tool = 'landcover' AND request_id % 7 = 0))"


@query("tool_fallback", f"""WITH {_MODE}, tl(tool, task, tier, lo, hi, modes, needs, ord) AS (VALUES {_TOOL_ROWS}), rq AS (SELECT request_id, modalities, mode, {list(_ASKED)}[1 + (request_id // 3) % {len(_ASKED)}] AS task FROM mo WHERE error IS NULL),
y AS (SELECT rq.*, tool, tier, ord, CASE WHEN len(modalities) < lo THEN 'too_few_images' WHEN len(modalities) > hi THEN 'too_many_images' WHEN NOT list_contains(modes, mode) THEN 'wrong_mode' WHEN NOT list_has_all(modalities, needs) THEN 'missing_modality' END AS broken FROM rq LEFT JOIN tl USING (task)),
x AS (SELECT *, coalesce(broken IS NULL AND {_FAILS}, FALSE) AS failed FROM y),
g AS (SELECT request_id, any_value(task) AS task, arg_min(tool, (tier, ord)) FILTER (broken IS NULL AND NOT failed) AS tool, min((tier, ord)) FILTER (broken IS NULL AND NOT failed) AS spot,
  arg_min(broken, (list_position({list(contracts.PRIORITY)}, broken), tier, ord)) FILTER (broken IS NOT NULL) AS broken, count(tool) AS known, count(tool) FILTER (NOT failed) AS n FROM x GROUP BY 1),
f AS (SELECT request_id, string_agg(x.tool, ',' ORDER BY tier, ord) AS tried FROM x JOIN g USING (request_id) WHERE failed AND (spot IS NULL OR (tier, ord) < spot) GROUP BY 1)
SELECT g.request_id, tool, tool || ' served ' || g.request_id AS answer, coalesce(tried, '') AS tried,
  CASE WHEN tool IS NOT NULL THEN NULL WHEN task IN {contracts.NOT_BUILT} THEN 'unsupported_task' WHEN known = 0 THEN 'not_dispatchable' WHEN n = 0 THEN 'model_unavailable' ELSE broken END AS error FROM g LEFT JOIN f USING (request_id)""")
def tool_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Who answers each request where the first tool fails for some of them."""
    task = F.element_at(F.array(*map(F.lit, _ASKED)), (1 + F.floor(F.col("request_id") / 3) % len(_ASKED)).cast("int"))
    rows = _image_sets(spark, sf).where("error IS NULL").select("request_id", "modalities", "mode", task.alias("task"))

    def tool(name: str):
        said = F.when(~F.expr(_FAILS), F.concat(F.lit(name + " served "), F.col("request_id").cast("string")))
        return lambda sent: sent.select("request_id", said.alias("answer"))

    found = contracts.served(rows, {t[0]: tool(t[0]) for t in contracts.TOOLS})
    return found.withColumn("tried", F.array_join("tried", ","))


@query("task_override", f"WITH x AS (SELECT event_id AS request_id, {list(_ASKED)}[1 + event_id % {len(_ASKED)}] AS routed, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'auto' WHEN 2 THEN '' ELSE {list(_ASKED)}[1 + (event_id // 5) % {len(_ASKED)}] END AS pinned FROM events) "
       "SELECT request_id, CASE WHEN coalesce(pinned, '') IN ('', 'auto') THEN routed ELSE pinned END AS task, coalesce(pinned, '') NOT IN ('', 'auto') AND pinned <> routed AS overridden FROM x")  # fmt: skip
def task_override(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    of = lambda n: F.element_at(F.array(*map(F.lit, _ASKED)), (1 + n % len(_ASKED)).cast("int"))
    pinned = F.when(e % 5 == 1, "auto").when(e % 5 == 2, "").when(e % 5 > 2, of(F.floor(e / 5)))
    return read(spark, sf, "events").withColumns({"routed": of(e), "pinned": pinned}).select(
        e.alias("request_id"), *[c.alias(n) for n, c in contracts.resolved_task(F.col("routed"), F.col("pinned")).items()]
    )


_ROLE_SETS = (["red", "green", "blue"], ["blue", "green", "red", "nir", "swir1", "swir2"], ["vv", "vh"], ["gray"], ["unknown", "unknown"], ["unknown", "nir"])
_ROLE_LISTS = "[" + ", ".join(f"{s}::VARCHAR[]" for s in _ROLE_SETS) + "]"


@query("shared_bands", f"WITH x AS (SELECT o_orderkey AS request_id, list_extract({_ROLE_LISTS}, 1 + o_orderkey % 6) AS a, list_extract({_ROLE_LISTS}, 1 + (o_orderkey // 6) % 6) AS b FROM orders) SELECT request_id, list_has_any(list_filter(a, lambda r: r <> 'unknown'), list_filter(b, lambda r: r <> 'unknown')) AS shared FROM x")
def shared_bands(spark: SparkSession, sf: str) -> DataFrame:
    sets = F.array(*[F.array(*map(F.lit, s)) for s in _ROLE_SETS])
    side = lambda n: F.element_at(sets, (1 + n % len(_ROLE_SETS)).cast("int"))
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("request_id"), contracts.shares_bands(side(k), side(F.floor(k / 6))).alias("shared"))


@query("scene_modality", f"""WITH x AS (SELECT s_suppkey AS scene_id, list_extract({_ROLE_LISTS}, 1 + s_suppkey % 6) AS roles, '/in/' || ['S1A_grd', 'Sentinel-2', 'subset', 'rgb_tile', 'RISAT'][1 + s_suppkey % 5] || '_' || s_suppkey || '.tif' AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'sensor=landsat 8' WHEN s_suppkey % 3 = 1 THEN 'note=none' ELSE '' END AS tags FROM supplier),
t AS (SELECT *, lower(string_split(path, '/')[-1] || ' ' || tags) AS h FROM x) SELECT scene_id, CASE WHEN {" OR ".join(f"contains(h, '{w}')" for w in geotiff.RADAR_WORDS)} THEN 'sar' WHEN {" OR ".join(f"contains(h, '{w}')" for w in geotiff.OPTICAL_WORDS)} THEN 'optical'
  WHEN list_has_any(roles, ['vv', 'vh']) THEN 'sar' WHEN list_has_any(roles, ['red', 'green', 'blue', 'nir']) THEN 'optical' ELSE 'unknown' END AS modality FROM t""")
def scene_modality(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    of = lambda values, n: F.element_at(F.array(*values), (1 + k % n).cast("int"))
    roles = of([F.array(*map(F.lit, s)) for s in _ROLE_SETS], 6)
    path = F.concat(F.lit("/in/"), of([F.lit(x) for x in ("S1A_grd", "Sentinel-2", "subset", "rgb_tile", "RISAT")], 5), F.lit("_"), k.cast("string"), F.lit(".tif"))
    tags = F.when(k % 3 == 0, F.create_map(F.lit("sensor"), F.lit("landsat 8"))).when(k % 3 == 1, F.create_map(F.lit("note"), F.lit("none")))
    return read(spark, sf, "supplier").select(k.alias("scene_id"), geotiff.modality(path, tags, roles).alias("modality"))


@query("band_roles", "WITH x AS (SELECT s_suppkey AS scene_id, [1, 2, 3, 4, 6, 12, 13, 5][1 + s_suppkey % 8] AS n, ['GTiff', 'PNG'][1 + (s_suppkey // 8) % 2] AS driver, ['optical', 'sar'][1 + (s_suppkey // 16) % 2] AS modality FROM supplier) SELECT scene_id, CASE WHEN modality = 'sar' THEN CASE n WHEN 1 THEN 'gray' WHEN 2 THEN 'vv,vh' ELSE array_to_string(list_transform(range(n), lambda i: 'unknown'), ',') END "
       "WHEN driver = 'PNG' AND n = 4 THEN 'red,green,blue,alpha' ELSE CASE n " + " ".join(f"WHEN {n} THEN '{','.join(roles)}'" for n, roles in geotiff.CONVENTIONS.items()) + " ELSE 'unknown,unknown,unknown,unknown,unknown' END END AS roles FROM x")  # fmt: skip
def band_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of scenes without descriptions, by number of bands, driver and sensor."""
    k = F.col("s_suppkey")
    of = lambda values, n, step=1: F.element_at(F.array(*map(F.lit, values)), (1 + F.floor(k / step) % n).cast("int"))
    meta = read(spark, sf, "supplier").select(k.alias("scene_id"), of((1, 2, 3, 4, 6, 12, 13, 5), 8).alias("band_count"), of(("GTiff", "PNG"), 2, 8).alias("driver"), of(("optical", "sar"), 2, 16).alias("modality"), F.array().cast("array<string>").alias("band_descriptions"))
    return geotiff.band_roles(meta).select("scene_id", F.array_join("band_roles", ",").alias("roles"))


@query("grid_text", f"WITH {_SC} SELECT scene_id, CASE WHEN NOT has_crs THEN 'pixel grid (no georeference)' WHEN scene_id % 4 = 0 THEN 'projected grid (CRS present, EPSG code unresolved)' ELSE 'EPSG:' || (32600 + scene_id % 60) || ' grid' END AS grid FROM sc")
def grid_text(spark: SparkSession, sf: str) -> DataFrame:
    epsg = F.when(F.col("scene_id") % 4 != 0, 32600 + F.col("scene_id") % 60)
    return scenes(spark, sf).select("scene_id", contracts.grid_text(F.col("has_crs"), epsg).alias("grid"))
