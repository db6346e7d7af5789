"""Queries that answer requests over scenes: grounding, questions, captions and change questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.operators import answers, change, confidence, grounding, landcover, language, provenance, radar
from pixelquarry.operators.staging import staged
from pixelquarry.operators.wording import filled_sql
from pixelquarry.plans import language as requests_plan
from pixelquarry.plans import scenes as scenes_plan
from pixelquarry.plans import spectral as spectral_plan
from pixelquarry.plans import sql
from pixelquarry.plans.language import _quote
from pixelquarry.sources.scenes import BANDS, pixel_grid

QUERIES: dict = {}
SQL: dict[str, str] = {}
AREA = 100.0


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return staged(landcover.with_indices(landcover.classify(pixel_grid(spark, sf, fields=True), list(BANDS)), ["ndwi"]))


def _scenes(px: DataFrame) -> DataFrame:
    """Of four scenes one is rotated and one has no georeference."""
    k = F.col("scene_id") % 4
    flags = {"georeferenced": k != 3, "north_up": k < 2, "pixel_area_m2": F.when(k != 3, AREA)}
    return px.groupBy("scene_id").agg(F.count("*").alias("frame_pixels")).withColumns(flags)


def _placed(spark: SparkSession, sf: str, requests: DataFrame, scenes: DataFrame) -> DataFrame:
    """Requests, each over one of the scenes in turn."""
    n = scenes.count()
    return requests.withColumn("scene_id", F.pmod("request_id", F.lit(n)))


_SCENES = "sc AS MATERIALIZED (SELECT scene_id, count(*) AS frame_pixels, scene_id % 4 <> 3 AS georeferenced, scene_id % 4 < 2 AS north_up, CASE WHEN scene_id % 4 <> 3 THEN 100.0::DOUBLE END AS pam FROM lc GROUP BY scene_id)"
_SECTORS = ", ".join(f"({_quote(n)}, {', '.join(map(str, b))})" for n, b in grounding.SECTORS.items())
_NAME = scenes_plan._NAME
#: CTEs rg (regions), jd (requests beside their regions) and the rest of a grounding.
_GROUND = f"""WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)}, {_SCENES}, {requests_plan._PARSED}, """ + ", ".join(
    f"on{k} AS (SELECT * FROM lc WHERE class_code = {k}), {sql.components(f'k{k}', f'on{k}')}, rl{k} AS (SELECT scene_id, r, c, {k} AS code, dense_rank() OVER (PARTITION BY scene_id ORDER BY lab) AS label FROM k{k}_l)" for k in (1, 2, 3, 4)
) + f""", rl AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM rl{k}" for k in (1, 2, 3, 4))}), fs AS (SELECT scene_id, max(r)+1 AS h, max(c)+1 AS w FROM lc GROUP BY 1),
st(sector, r0, r1, c0, c1) AS (VALUES {_SECTORS}),
rz AS (SELECT scene_id, code, label, count(*) AS pixel_area FROM rl GROUP BY scene_id, code, label HAVING count(*) >= 25 QUALIFY row_number() OVER (PARTITION BY scene_id, code ORDER BY count(*) DESC, label) <= 200),
rg AS MATERIALIZED (SELECT scene_id, {_NAME.format('code')} AS class, code, label, pixel_area FROM rz),
ov AS MATERIALIZED (SELECT scene_id, code, label, sector, count(*) AS inside FROM rl JOIN fs USING (scene_id) JOIN st ON r >= round_even(r0*h, 0) AND r < round_even(r1*h, 0) AND c >= round_even(c0*w, 0) AND c < round_even(c1*w, 0) GROUP BY ALL),
sq AS (SELECT *, request_id % (SELECT count(*) FROM sc) AS scene_id FROM pg),
ad AS MATERIALIZED (SELECT sq.* EXCLUDE (error), sc.pam, CASE WHEN error IS NOT NULL THEN error WHEN sector IS NOT NULL AND NOT frame_relative AND sector <> 'centre' AND NOT north_up THEN 'not_north_up'
  WHEN (min_area_m2 IS NOT NULL OR max_area_m2 IS NOT NULL) AND NOT georeferenced THEN 'no_ground_size' END AS error FROM sq JOIN sc USING (scene_id)),
j0 AS (SELECT ad.*, rg.code, rg.label, rg.pixel_area, rg.pixel_area*pam AS area_m2, CASE WHEN ad.sector IS NOT NULL THEN coalesce(inside, 0)/pixel_area END AS sector_overlap
  FROM ad JOIN rg ON rg.scene_id = ad.scene_id AND rg.class = target LEFT JOIN ov ON ov.scene_id = rg.scene_id AND ov.code = rg.code AND ov.label = rg.label AND ov.sector = ad.sector WHERE error IS NULL),
j1 AS (SELECT *, CASE WHEN sector_overlap <= 0.5 THEN 'outside_sector' WHEN pixel_area < min_pixels THEN 'below_min_pixels' WHEN pixel_area > max_pixels THEN 'above_max_pixels'
  WHEN (min_area_m2 IS NOT NULL OR max_area_m2 IS NOT NULL) AND area_m2 IS NULL THEN 'area_unknown' WHEN area_m2 < min_area_m2 THEN 'below_min_area' WHEN area_m2 > max_area_m2 THEN 'above_max_area' END AS lo FROM j0),
j2 AS (SELECT *, CASE WHEN lo IS NULL THEN row_number() OVER (PARTITION BY request_id, lo IS NULL ORDER BY CASE WHEN superlative = 'smallest' THEN pixel_area ELSE -pixel_area END, label) END AS place FROM j1),
jd AS MATERIALIZED (SELECT *, CASE WHEN place > "limit" THEN 'beyond_limit' ELSE lo END AS left_out FROM j2)"""


def _grounded(spark: SparkSession, sf: str, px: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is asked, once; the regions judged for it; the labels of pixels, the sizes of classes, and which
    requests ask it."""
    px = _classified(spark, sf) if px is None else px
    scores = {name: landcover.class_score(name, ["mndwi", "ndwi", "ndvi", "ndbi"]) for name in landcover.CLASS_INDICES}
    regions, labels = grounding.class_regions(px, scores, landcover.min_patch(px, ["scene_id"], AREA))
    scenes = staged(_scenes(px))
    parsed = staged(_placed(spark, sf, language.parse_grounding(requests_plan.requests(spark, sf)), scenes))
    asked, members = grounding.once(grounding.admitted(parsed, scenes))
    asked = staged(asked)
    sizes = px.groupBy("scene_id", landcover.code_name(F.col("class_code")).alias("class")).agg(F.count("*").alias("class_pixels"))
    return asked, grounding.judged(asked, staged(regions)), labels, sizes, members


def _for_all(rows: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for a thing that is asked, for every request that asks it."""
    return members.join(rows.withColumnRenamed("request_id", "asked_as"), "asked_as").drop("asked_as")


@query("ground_regions", f"{_GROUND} SELECT request_id, scene_id, target AS class, label::INT AS label, place::INT AS place, pixel_area, round(area_m2, 6) AS area_m2, round(sector_overlap, 6) AS sector_overlap FROM jd WHERE left_out IS NULL")
def ground_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions that each request is answered with."""
    _, found, _, _, members = _grounded(spark, sf)
    kept = found.where("left_out IS NULL").select("request_id", "scene_id", "class", "label", "place", "pixel_area", F.round("area_m2", 6).alias("area_m2"), F.round("sector_overlap", 6).alias("sector_overlap"))
    return _for_all(kept, members)


_PCT = "(round({}*100)::BIGINT || '%')"
_LEFT_OUT = (*grounding.TESTS, "beyond_limit")
_KM = "printf('%.2f', round({}/1e6, 2)) || ' km²'"
_GROUND_TOTALS = f"""{_GROUND}, cp AS (SELECT scene_id, {_NAME.format('class_code')} AS class, count(*) AS class_pixels FROM lc GROUP BY ALL),
tt AS (SELECT request_id, count(*) FILTER (left_out IS NULL) AS regions, sum(pixel_area) FILTER (left_out IS NULL)::BIGINT AS selected_pixels, sum(area_m2) FILTER (left_out IS NULL) AS selected_area_m2,
  {", ".join(f"count(*) FILTER (left_out = '{n}') AS {n}" for n in _LEFT_OUT)} FROM jd GROUP BY 1),
gt AS (SELECT ad.request_id, error, target, sector_phrase, replace(target, '_', ' ') AS nm, coalesce(regions, 0) AS regions, coalesce(selected_pixels, 0) AS selected_pixels, selected_area_m2, coalesce(class_pixels, 0) AS class_pixels,
  coalesce(class_pixels/frame_pixels, 0) AS coverage, {", ".join(f"coalesce({n}, 0) AS {n}" for n in _LEFT_OUT)}, target NOT IN ('built_up', 'bare_soil') AS count_reportable
  FROM ad JOIN sc USING (scene_id) LEFT JOIN tt USING (request_id) LEFT JOIN cp ON cp.scene_id = ad.scene_id AND cp.class = target),
gw AS (SELECT *, coalesce({filled_sql('ground.where', place='sector_phrase')}, '') AS whr FROM gt),
gx AS (SELECT *, coalesce({filled_sql('ground.area', area=_KM.format('selected_area_m2'), pixels='selected_pixels')}, {filled_sql('ground.pixels', pixels='selected_pixels')}) AS ext FROM gw)"""
_SAID = {"class": "nm", "where": "whr", "extent": "ext", "n": "regions"}
_GROUND_SAID = f"""CASE WHEN class_pixels = 0 THEN {filled_sql('ground.absent', **_SAID)} WHEN regions = 0 THEN {filled_sql('ground.unmatched', **_SAID)}
  WHEN NOT count_reportable THEN {filled_sql('ground.uncounted', **_SAID)} WHEN regions = 1 THEN {filled_sql('ground.one', **_SAID)} ELSE {filled_sql('ground.many', **_SAID)} END"""


@query("ground_answers", f"{_GROUND_TOTALS} SELECT request_id, error, " + ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {n}" for c, n in [
    *[(n, n) for n in ("regions", "selected_pixels")], ("round(selected_area_m2, 6)", "selected_area_m2"), ("class_pixels", "class_pixels"), ("round(coverage, 6)", "coverage"), *[(n, n) for n in _LEFT_OUT], ("count_reportable", "count_reportable"),
    (_GROUND_SAID, "answer")]) + " FROM gx")
def ground_answers(spark: SparkSession, sf: str) -> DataFrame:
    asked, found, _, sizes, members = _grounded(spark, sf)
    said = grounding.answers(asked, found, sizes).withColumns({n: F.round(n, 6) for n in ("selected_area_m2", "coverage")})
    return _for_all(said, members)


#: The same over maps that radar was fused into; in every second scene it parted bright echoes from the rest.
_FUSED_MAP = scenes_plan._FUSED.removeprefix("WITH RECURSIVE ").replace(sql.landcover("lc", sql.FIELDS), sql.landcover("l0", sql.FIELDS)).replace("FROM lc JOIN", "FROM l0 JOIN").replace("rg AS", "zg AS").replace("JOIN rg", "JOIN zg") + ", lc AS (SELECT scene_id, r, c, fused AS class_code FROM fu)"
_FUSED_GROUND = _GROUND_TOTALS.replace(sql.landcover("lc", sql.FIELDS), _FUSED_MAP).replace("target NOT IN ('built_up', 'bare_soil') AS count_reportable", "(target NOT IN ('built_up', 'bare_soil') OR ad.scene_id % 2 = 0) AS count_reportable")


@query("ground_fused_answers", f"{_FUSED_GROUND} SELECT request_id, error, CASE WHEN error IS NULL THEN regions END AS regions, CASE WHEN error IS NULL THEN count_reportable END AS count_reportable, CASE WHEN error IS NULL THEN {_GROUND_SAID} END AS answer FROM gx")
def ground_fused_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Requests over fused maps: the number of built-up areas is told where radar parts them."""
    px = _classified(spark, sf)
    fused = scenes_plan._fused(spark, sf).select("scene_id", "r", "c", F.col("fused_code").alias("class_code"))
    px = staged(px.drop("class_code").join(fused, ["scene_id", "r", "c"]))
    asked, found, _, sizes, members = _grounded(spark, sf, px)
    parted = px.select("scene_id").distinct().withColumn("radar_parts", F.col("scene_id") % 2 == 0)
    return _for_all(grounding.answers(asked, found, sizes, parted).select("request_id", "error", "regions", "count_reportable", "answer"), members)


_FUSION_LEAD = filled_sql("fusion.lead", top="top", share=_PCT.format("share"), both=_PCT.format("(agreed/classified)"))
_PART = "printf('%.1f', round(part*100, 1)) || '%'"
_WHO = "CASE arbiter WHEN 'sar' THEN 'radar' WHEN 'optical' THEN 'the optical image' END"


@query("fusion_answers", f"""{scenes_plan._FUSED}, fs AS (SELECT scene_id, replace({_NAME.format('fused')}, '_', ' ') AS nm, count(*) AS n, count(*) FILTER (ev = 1) AS b FROM fu WHERE fused > 0 GROUP BY ALL),
wh AS (SELECT scene_id, arg_min(nm, (-n, nm)) AS top, max(n)/sum(n) AS share, sum(b) AS agreed, sum(n) AS classified FROM fs GROUP BY 1),
tc AS (SELECT scene_id, count(*) AS total FROM fu GROUP BY 1), cg AS (SELECT scene_id, {_NAME.format('class_code')} AS oc, {scenes_plan._REGIME} AS rg2, {_NAME.format('fused')} AS ra, arbiter, count(*) AS n FROM fu WHERE ev = 2 GROUP BY ALL),
df AS (SELECT cg.*, n/total AS part FROM cg JOIN tc USING (scene_id) QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, oc, rg2, ra) = 1)
SELECT tc.scene_id, coalesce({_FUSION_LEAD} || CASE WHEN df.n IS NULL THEN '' ELSE coalesce({filled_sql('fusion.decided', part=_PART, arbiter=_WHO, **{'class': "replace(ra, '_', ' ')"})}, {filled_sql('fusion.open', part=_PART)}) END, {filled_sql('fusion.none')}) AS answer
FROM tc LEFT JOIN wh USING (scene_id) LEFT JOIN df USING (scene_id)""")  # fmt: skip
def fusion_answers(spark: SparkSession, sf: str) -> DataFrame:
    fused = staged(scenes_plan._fused(spark, sf))
    return answers.fusion_answers(radar.fused_stats(fused), radar.conflict_groups(fused, AREA), fused.select("scene_id").distinct())


@query("ground_selection", f"{_GROUND} SELECT request_id, count(*) AS pixels, sum(r) AS rows_sum, sum(c) AS columns_sum FROM jd JOIN rl USING (scene_id, code, label) WHERE left_out IS NULL GROUP BY request_id".replace("sum(r)", "sum(r)::BIGINT").replace("sum(c)", "sum(c)::BIGINT"))
def ground_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The mask that an answer shows, as its pixels and the sums of their places."""
    _, found, labels, _, members = _grounded(spark, sf)
    totals = grounding.selection(found, labels).groupBy("request_id").agg(F.count("*").alias("pixels"), F.sum("r").alias("rows_sum"), F.sum("c").alias("columns_sum"))
    return _for_all(totals, members)


#: CTE cs: class statistics with names and areas, and their order in a scene.
_STATS = f"""lt AS (SELECT scene_id, count(*) FILTER (valid) AS total FROM lc GROUP BY 1),
ks AS MATERIALIZED (SELECT scene_id, {_NAME.format('class_code')} AS class, replace({_NAME.format('class_code')}, '_', ' ') AS nm, count(*)/any_value(total) AS fraction, count(*)*100.0::DOUBLE AS area FROM lc JOIN lt USING (scene_id) WHERE class_code > 0 GROUP BY scene_id, class_code)"""
_LISTING = f"string_agg(nm || ' ' || {_PCT.format('fraction')}, ', ' ORDER BY fraction DESC, {{}})"


_ABOUT = {"class": "nm", "extent": "ext"}


@query("answer_questions", f"""WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)}, {_STATS}, {requests_plan._INTENT}, ns AS (SELECT count(DISTINCT scene_id) AS n FROM lc),
qs AS (SELECT request_id, request_id % n AS scene_id, intent, targets FROM vi, ns),
nq AS (SELECT request_id, scene_id, intent, k, t AS class, replace(t, '_', ' ') AS nm, coalesce(fraction, 0) AS fraction, area FROM (SELECT *, unnest(string_split(targets, ',')) AS t, unnest(range(len(string_split(targets, ',')))) AS k FROM qs WHERE targets <> '') q LEFT JOIN ks USING (scene_id) WHERE ks.class = t
  UNION ALL SELECT request_id, scene_id, intent, k, t, replace(t, '_', ' '), 0, NULL FROM (SELECT *, unnest(string_split(targets, ',')) AS t, unnest(range(len(string_split(targets, ',')))) AS k FROM qs WHERE targets <> '') q WHERE NOT EXISTS (SELECT 1 FROM ks WHERE ks.scene_id = q.scene_id AND ks.class = t)),
on1 AS (SELECT request_id, arg_max(nm, (fraction, -k)) AS nm, max(fraction) AS fraction, arg_max(area, (fraction, -k)) AS area, {_LISTING.format('k')} AS listing, list(nm ORDER BY fraction DESC, k)[2] AS nm2, list(fraction ORDER BY fraction DESC, k)[2] AS f2 FROM nq GROUP BY 1),
wh AS (SELECT scene_id, arg_min(nm, (-fraction, class)) AS top, max(fraction) AS tf, {_LISTING.format('class')} AS listing FROM ks GROUP BY 1),
ex AS (SELECT *, coalesce({filled_sql('extent.area', share=_PCT.format('fraction'), area=_KM.format('area'))}, {_PCT.format('fraction')}) AS ext FROM on1)
SELECT qs.request_id, intent, CASE intent WHEN 'composition' THEN coalesce({filled_sql('mix.whole', top='top', share=_PCT.format('tf'), list='wh.listing')}, {filled_sql('mix.none')})
  WHEN 'comparison' THEN CASE WHEN fraction = f2 THEN {filled_sql('pair.equal', first='nm', second='nm2', list='ex.listing')} ELSE {filled_sql('pair.more', first='nm', list='ex.listing')} END
  {" ".join(f"WHEN '{k}' THEN CASE WHEN fraction = 0 THEN {filled_sql(k + '.no', **_ABOUT)} ELSE {filled_sql(k + '.yes', **_ABOUT)} END" for k in ('presence', 'quantity', 'count', 'location'))} END AS answer,
  CASE WHEN intent IN ('count', 'location') AND fraction > 0 THEN 'grounding' END AS redirect
FROM qs LEFT JOIN ex USING (request_id) LEFT JOIN wh ON wh.scene_id = qs.scene_id""")  # fmt: skip
def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    px = _classified(spark, sf)
    stats = staged(landcover.class_stats(px, AREA))
    asked = _placed(spark, sf, language.vqa_intent(requests_plan.requests(spark, sf)), px.select("scene_id").distinct())
    return answers.answer_questions(asked, stats).select("request_id", "intent", "answer", "redirect")


@query("captions", f"""WITH RECURSIVE {sql.landcover('lc', sql.FIELDS)}, {_STATS}, rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY fraction DESC, class) AS k FROM ks),
cx AS (SELECT scene_id, any_value(nm) FILTER (k = 1) AS top, any_value(fraction) FILTER (k = 1) AS tf, string_agg(nm || ' ' || {_PCT.format('fraction')}, ', ' ORDER BY k) FILTER (k > 1) AS rest, sum(area) AS area FROM rk GROUP BY 1)
SELECT scene_id, coalesce({filled_sql('caption.whole', top='top', share=_PCT.format('tf'), others=f"coalesce({filled_sql('caption.others', list='rest')}, '')", area=filled_sql('caption.area', area=_KM.format('area')))}, {filled_sql('caption.none')}) AS caption FROM (SELECT DISTINCT scene_id FROM lc) LEFT JOIN cx USING (scene_id)""")  # fmt: skip
def captions(spark: SparkSession, sf: str) -> DataFrame:
    px = _classified(spark, sf)
    return answers.captions(landcover.class_stats(px, AREA), px.select("scene_id").distinct())


_WORDS = " ".join(f"WHEN regexp_matches(lower(query), '\\b({'|'.join(words)})') THEN '{name}'" for name, words in answers.CHANGE_WORDS.items())
_ASKS = "(" + " OR ".join(f"contains(lower(query), '{p}')" for p in answers.EXTENT_WORDS) + ")"


@query("read_change_question", f"WITH {requests_plan._REQ} SELECT request_id, CASE {_WORDS} END AS mentioned, {_ASKS} AS asks_extent FROM rq")
def read_change_question(spark: SparkSession, sf: str) -> DataFrame:
    found = answers.read_change_question(F.col("query"))
    return requests_plan.requests(spark, sf).select("request_id", *[c.alias(n) for n, c in found.items()])


def _conversion(t: str) -> str:
    return filled_sql("change.conversion", before=f"replace({t}.before, '_', ' ')", after=f"replace({t}.after, '_', ' ')", share=_PCT.format(f"{t}.foc"))


_NET = {"class": "replace(rd.mentioned, '_', ' ')", "amount": _KM.format("abs(dm)"), "relative": f"coalesce({filled_sql('change.relative', share=_PCT.format('abs(rel)'))}, '')"}
_WENT = f"CASE WHEN delta = 0 THEN {filled_sql('change.still', **_NET)} WHEN delta > 0 THEN {filled_sql('change.more', **_NET)} ELSE {filled_sql('change.less', **_NET)} END"
_BOTH = _PCT.format("(cor/changed)")
_CHANGED = {
    "not comparable": filled_sql("change.apart"),
    "no-change": filled_sql("change.none"),
    "changed extent": filled_sql("change.extent", tenth="tenth", about=filled_sql("change.about", area=_KM.format("m2"), pixels="changed"), both=_BOTH),
    "general change summary": filled_sql("change.whole", tenth="tenth", area=f"' (' || {_KM.format('m2')} || ')'", named=f"coalesce({filled_sql('change.named', conversion=_conversion('tp'))}, {filled_sql('change.unnamed')})", both=_BOTH),
}
_OF_CLASS = filled_sql("change.class", net=_WENT, tenth="tenth", conversion=f"coalesce({filled_sql('change.touching', conversion=_conversion('ts'))}, '')")


@query("answer_change_questions", f"""{scenes_plan._PAIR}, {requests_plan._REQ}, ns AS (SELECT count(DISTINCT scene_id) AS n FROM pr),
cq AS (SELECT request_id, request_id % n AS scene_id, CASE {_WORDS} END AS mentioned, {_ASKS} AS asks FROM rq, ns),
tl AS (SELECT scene_id, count(*) FILTER (changed) AS changed, count(*) FILTER (valid) AS valid, count(*) FILTER (spectral AND by_class) AS cor, (count(*) FILTER (changed))*100.0::DOUBLE AS m2 FROM ch GROUP BY 1),
dk AS (SELECT scene_id, k, count(*) FILTER (valid AND cb = k) AS b, count(*) FILTER (valid AND ca = k) AS a FROM pr, range(1, 5) g(k) GROUP BY ALL),
dl AS (SELECT scene_id, {_NAME.format('k')} AS mentioned, a - b AS delta, CASE WHEN b > 0 THEN (a-b)/b END AS rel, (a-b)*100.0::DOUBLE AS dm FROM dk WHERE a + b > 0),
tr AS (SELECT scene_id, {_NAME.format('cb')} AS before, {_NAME.format('ca')} AS after, {scenes_plan._TYPE} AS ct, count(*) AS n, avg(spectral::INT) AS ag, count(*)/sum(count(*)) OVER (PARTITION BY scene_id) AS foc FROM ch WHERE changed GROUP BY scene_id, cb, ca),
rp AS (SELECT * FROM tr WHERE scene_id % 3 <> 1 AND ag >= 0.6 AND ct <> 'spectral_only'),
tp AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, before, after) = 1),
sd AS (SELECT *, unnest(list_distinct([before, after])) AS mentioned FROM rp),
ts AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY scene_id, mentioned ORDER BY n DESC, before, after) = 1),
rd AS (SELECT cq.*, changed, valid, cor, m2, delta, rel, dm, CASE WHEN coalesce(valid, 0) = 0 THEN 'not comparable' WHEN coalesce(changed, 0) = 0 THEN 'no-change' WHEN delta IS NOT NULL THEN 'net change in ' || mentioned WHEN asks THEN 'changed extent' ELSE 'general change summary' END AS reading,
  printf('%.1f', round(changed/nullif(valid, 0)*100, 1)) || '%' AS tenth FROM cq JOIN tl USING (scene_id) LEFT JOIN dl USING (scene_id, mentioned))
SELECT request_id, reading, CASE reading {" ".join(f"WHEN '{n}' THEN {t}" for n, t in _CHANGED.items())} ELSE {_OF_CLASS} END AS answer
FROM rd LEFT JOIN tp USING (scene_id) LEFT JOIN ts ON ts.scene_id = rd.scene_id AND ts.mentioned = rd.mentioned""")  # fmt: skip
def answer_change_questions(spark: SparkSession, sf: str) -> DataFrame:
    pair = staged(scenes_plan._pair(spark, sf))
    found = staged(change.detect(pair))
    totals = found.groupBy("scene_id").agg(
        F.count_if("changed").alias("changed"), F.count_if("valid").alias("valid"), F.count_if(F.expr("spectral AND by_class")).alias("corroborated"), (F.count_if("changed") * F.lit(AREA)).alias("changed_m2")
    )
    trans = change.reportable(change.transitions(found, AREA), F.col("scene_id") % 3 != 1)
    asked = _placed(spark, sf, requests_plan.requests(spark, sf), pair.select("scene_id").distinct())
    return answers.answer_change_questions(asked, totals, change.class_deltas(pair, AREA), staged(trans))


@query("dominant_transition", f"""{scenes_plan._PAIR}, tr AS (SELECT scene_id, {_NAME.format('cb')} AS before, {_NAME.format('ca')} AS after, {scenes_plan._TYPE} AS change_type, count(*) AS pixel_count, avg(spectral::INT) AS ag FROM ch WHERE changed GROUP BY scene_id, cb, ca)
SELECT scene_id, before, after, change_type, pixel_count, scene_id % 3 <> 1 AND ag >= 0.6 AS reportable, CASE WHEN scene_id % 3 = 1 THEN 'registration' WHEN ag < 0.6 THEN 'agreement' END AS withheld FROM tr WHERE change_type <> 'spectral_only'
QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY pixel_count DESC, before, after) = 1""")  # fmt: skip
def dominant_transition(spark: SparkSession, sf: str) -> DataFrame:
    found = change.transitions(scenes_plan._detected(spark, sf), AREA)
    return change.dominant_transition(change.reportable(found, F.col("scene_id") % 3 != 1))


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene's land cover, weighed by what was measured of it: its picture's quality and its classes'
    separability."""
    rows = spectral_plan.input_quality(spark, sf).withColumnsRenamed({"score": "quality", "warnings": "codes"})
    rows = provenance.started(rows.join(scenes_plan.class_separability(spark, sf), "scene_id"))
    rows = provenance.step(rows, "quality", F.format_string("scored %.2f", "quality"), warned=F.col("codes") != "")
    rows = provenance.warn(rows, "quality", F.filter(F.split("codes", ","), lambda c: c != ""))
    rows = provenance.step(rows, "landcover", F.lit("classified"))
    rows = provenance.observe(rows, "landcover", F.array(F.format_string("separability %.2f", "separability")))
    rows = rows.withColumn("n_warnings", F.size(provenance.warnings()))
    return provenance.reduced(provenance.weigh(rows, "landcover", confidence.for_landcover(rows)))


_WEIGHED = f"""q AS MATERIALIZED ({spectral_plan.SQL['input_quality']}), s AS MATERIALIZED ({scenes_plan.SQL['class_separability']}),
f AS (SELECT scene_id, q.score AS quality, separability, warnings, len(list_filter(string_split(warnings, ','), lambda x: x <> '')) AS n FROM q JOIN s USING (scene_id)),
u AS (SELECT *, greatest(1 - 0.15*n, 0.4)::DOUBLE AS w, least(greatest(separability, 0), 1)::DOUBLE AS sp, least(greatest(quality, 0), 1)::DOUBLE AS ql FROM f),
m AS (SELECT *, (0.45*sp + 0.1*w + 0.25*ql)/0.8 AS mean FROM u),
z AS (SELECT *, least(mean, sp) AS total, CASE WHEN sp < mean OR (sp <= w AND sp <= ql) THEN 'class_separability' WHEN w <= ql THEN 'warnings' ELSE 'input_quality' END AS limiting FROM m)"""


@query("assessments", f"""WITH {_WEIGHED} SELECT scene_id, round(total, 6) AS score, CASE WHEN total >= 0.75 THEN 'high' WHEN total >= 0.5 THEN 'medium' WHEN total >= 0.25 THEN 'low' ELSE 'insufficient' END AS level,
  limiting AS limiting_factor, warnings, CASE WHEN total < 0.25 OR n > 0 THEN 'partial' ELSE 'success' END AS status, 'quality:' || CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END || ',landcover:ok' AS steps FROM z""")
def assessments(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["step"], x["status"])), ",")
    return _assessed(spark, sf).select("scene_id", F.round("score", 6).alias("score"), "level", "limiting_factor", F.array_join("warnings", ",").alias("warnings"), "status", steps.alias("steps"))


@query("assessment_evidence", f"""WITH {_WEIGHED} SELECT scene_id, unnest(range(4))::INT AS ord, unnest(['observation', 'quality', 'measurement', 'measurement']) AS type, unnest(['landcover', 'landcover:class_separability', 'landcover:warnings', 'landcover:input_quality']) AS source,
  unnest([NULL, round(sp, 6), round(w, 6), round(ql, 6)]) AS value, unnest(['separability ' || printf('%.2f', separability), 'class separability scored ' || printf('%.2f', round(separability, 2)), 'warnings scored ' || printf('%.2f', round(w, 2)), 'input quality scored ' || printf('%.2f', round(quality, 2))]) AS description FROM z""")
def assessment_evidence(spark: SparkSession, sf: str) -> DataFrame:
    items = _assessed(spark, sf).select("scene_id", F.posexplode("evidence").alias("ord", "e"))
    return items.select("scene_id", "ord", "e.type", "e.source", F.round("e.value", 6).alias("value"), "e.description")
