"""The engine's front door: route a request over scenes, answer it with measured figures, and say how sure it is."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.operators import answers, change, confidence, contracts, geometry, grounding, kernels, landcover, language, projection, provenance, quality, radar, registration, thresholds
from pixelquarry.operators.staging import on_one_machine, staged
from pixelquarry.sources.sinks import RecordStore

#: Indices that a class map carries, if its bands allow them.
INDICES = ("mndwi", "ndwi", "ndvi", "ndbi")
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Refused(ValueError):
    """A request that the available inputs or analyses can't answer; ``code`` says why."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


@cache
def _packed() -> str:
    """The package as an archive, for Spark to send to the executors."""
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(), "pixelquarry"), "zip", _PACKAGE, "pixelquarry")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers find this package, wherever the driver was started: on one machine by this
    folder's path, on a cluster, where that doesn't exist, by an archive that Spark sends."""
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if not on_one_machine(spark):
        context.addPyFile(_packed())
    elif _PACKAGE not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_PACKAGE, known]))


@dataclass
class Scene:
    """A scene's pixels (scene_id, r, c, bands) and what is known of its grid.

    ``affine`` (a, b, c, d, e, f) and ``epsg`` place it on the ground; without them it is a bare grid.
    """

    pixels: DataFrame
    bands: list[str]
    modality: str = "optical"
    pixel_area: float | None = None
    north_up: bool = True
    affine: tuple[float, ...] | None = None
    epsg: int | None = None

    @property
    def placed(self) -> bool:
        return self.epsg is not None and self.affine is not None and tuple(self.affine) != geometry.IDENTITY


@dataclass
class Answer:
    """``figures`` are the analysis's own rows; ``report`` has a row a scene: answer, confidence with its
    limiting factor and reasons, warnings, evidence, timed steps, status and the record's id."""

    task: str
    text: str
    figures: DataFrame
    report: DataFrame
    trace: list[str] = field(default_factory=list)


@dataclass
class _Found:
    """What a tool gives: figures, a sentence a scene, and what it measured for its confidence."""

    figures: DataFrame
    said: DataFrame
    facts: DataFrame
    factors: Callable[[DataFrame], Column]
    lines: Column
    codes: Column | None = None


class Engine:
    """Answers a request over one scene, or over two of one place.

    Pixels may hold many scenes, by scene_id: figures and reports then have their rows, and the text is
    that of the first. Two inputs are paired by scene_id, or are one pair if each holds one scene; the second is
    brought on the first one's grid where both are placed, and refused where they can't be compared. With a
    ``store``, reports are kept there under the identifiers that it gives.
    """

    def __init__(self, spark: SparkSession, store: RecordStore | None = None) -> None:
        self.spark, self.store = spark, store
        ship_package(spark)

    def analyze(self, query: str, scenes: list[Scene], task: str | None = None) -> Answer:
        """Pair and align the scenes, classify the query, find the tool, run it, word the answer, weigh it.

        ``task`` pins the task whatever the query says. A tool that fails when it runs is passed over and the
        next one that takes the request is tried.
        """
        clock = [time.monotonic()]

        def lap() -> int:
            clock.append(time.monotonic())
            return round((clock[-1] - clock[-2]) * 1000)

        scenes, codes, strategy = self._aligned(scenes)
        steps = [("inputs", f"{len(scenes)} image(s), {strategy}", lap())]
        modalities = [s.modality for s in scenes]
        n_sar = modalities.count("sar")
        ddl = "request_id long, query string, modalities array<string>, n_images int, n_sar int, n_optical int, pinned string"
        request = self.spark.createDataFrame([(1, query, modalities, len(scenes), n_sar, len(scenes) - n_sar, task)], ddl)
        request = request.withColumns(contracts.input_mode(F.col("modalities"), F.lit(True)))
        routed = language.route(language.classify(request).join(request.drop("query"), "request_id"))
        resolved = contracts.resolved_task(F.col("routed"), F.col("pinned"))
        routed = staged(routed.withColumns({"wanted": resolved["task"], "overridden": resolved["overridden"], "unknown": contracts.undetermined(F.col("modalities"), F.col("mode"))}))
        found = routed.first()
        if found["error"]:
            raise Refused(found["error"].upper())
        if found["wanted"] == "unknown":
            raise Refused("UNRESOLVED_REQUEST")
        codes += ["undetermined_sensor"] if found["unknown"] else []
        pinned = " (pinned)" if found["overridden"] else ""
        steps.append(("route", f"{found['task']} -> {found['wanted']}{pinned}, {found['mode']}", lap()))

        result, tool, out = None, None, ["scene-model"]
        while result is None:
            asked = routed.select("request_id", F.col("wanted").alias("task"), "mode", "modalities")
            choice = contracts.dispatch(asked, tuple(out)).first()
            if choice["tool"] is None:
                raise Refused(choice["error"].upper())
            tool = choice["tool"]
            try:
                result = self._tools()[tool](query, scenes)
                report = self._report(query, tool, scenes, result, codes, steps, lap)
            except Refused:
                raise
            except Exception as failed:
                result = None
                out.append(tool)
                codes.append("tool_failed")
                steps.append((tool, f"failed: {type(failed).__name__}", lap()))
                if not self._others(routed, out):
                    raise
        if self.store is not None:
            report = self.store.add(report, "created_at", "scene_id")
        first = report.orderBy("scene_id").first()
        text = first["answer"] if first else ""
        trace = [f"{s['step']}: {s['details']}" for s in first["steps"]] if first else []
        return Answer(found["wanted"], text, result.figures, report, trace)

    def _tools(self) -> dict[str, Callable[[str, list[Scene]], _Found]]:
        return {
            "landcover": self._land_cover,
            "captioning": self._caption,
            "vqa": self._question,
            "grounding": self._ground,
            "change": lambda _, scenes: self._change_question("", scenes),
            "change-vqa": self._change_question,
            "sar": self._radar,
            "fusion": self._fusion,
        }

    def _others(self, routed: DataFrame, out: list[str]) -> bool:
        asked = routed.select("request_id", F.col("wanted").alias("task"), "mode", "modalities")
        return contracts.dispatch(asked, tuple(out)).first()["tool"] is not None

    def _report(self, query: str, tool: str, scenes: list[Scene], found: _Found, codes: list[str], steps: list[tuple[str, str, int]], lap: Callable[[], int]) -> DataFrame:
        """A row a scene: its answer, and its provenance reduced."""
        rows = found.said.join(found.facts, "scene_id", "left")
        for k, scene in enumerate(scenes):
            own = quality.input_quality(scene.pixels, scene.bands)
            rows = rows.join(own.select("scene_id", F.col("score").alias(f"_q{k}"), F.col("warnings").alias(f"_w{k}")), "scene_id", "left")
        rows = staged(rows)
        ran = [*steps, (tool, "measured and answered", lap())]
        rows = provenance.started(rows)
        for name, details, ms in ran:
            rows = provenance.step(rows, name, F.lit(details), ms)
        rows = provenance.warn(rows, "inputs", F.array(*[F.lit(c) for c in codes]).cast("array<string>"))
        for k in range(len(scenes)):
            rows = provenance.warn(rows, "quality", F.col(f"_w{k}"))
        if found.codes is not None:
            rows = provenance.warn(rows, tool, found.codes)
        rows = provenance.observe(rows, tool, found.lines)
        marks = [F.col(f"_q{k}") for k in range(len(scenes))]
        rows = rows.withColumns({"quality": marks[0] if len(marks) == 1 else F.least(*marks), "n_warnings": F.size(provenance.warnings())})
        rows = provenance.reduced(provenance.weigh(rows, tool, found.factors(rows)))
        record = F.concat_ws("-", F.lit(uuid.uuid4().hex), F.col("scene_id").cast("string")).alias("id")
        kept = ["answer", "status", "score", "level", "limiting_factor", "reasons", "warnings", "evidence", "steps"]
        told = [F.col("scene_id"), F.lit(query).alias("query"), F.lit(tool).alias("tool"), *kept]
        return staged(rows.select(record, *told) if self.store is None else rows.select(*told, F.current_timestamp().alias("created_at")))

    # Two inputs on one grid.

    def _aligned(self, scenes: list[Scene]) -> tuple[list[Scene], list[str], str]:
        """The scenes, the second one by the first one's identifiers and on its grid; warnings; the strategy."""
        if len(scenes) != 2:
            return scenes, [], "one grid"
        one, two = scenes
        ids = [s.pixels.groupBy("scene_id").agg((F.max("r") + 1).alias(f"h{k}"), (F.max("c") + 1).alias(f"w{k}")) for k, s in enumerate(scenes)]
        counts = [staged(x) for x in ids]
        n = [x.count() for x in counts]
        if n == [1, 1]:
            own = counts[0].first()["scene_id"]
            relabelled = lambda df: df.withColumn("scene_id", F.lit(own))
            two = Scene(relabelled(two.pixels), two.bands, two.modality, two.pixel_area, two.north_up, two.affine, two.epsg)
            counts[1] = relabelled(counts[1])
        both = staged(counts[0].join(counts[1], "scene_id"))
        if not n[0] == n[1] == both.count():
            raise Refused("PAIR_UNMATCHED")
        same = both.where("h0 = h1 AND w0 = w1").count() == n[0]
        if not (one.placed and two.placed):
            if not same:
                raise Refused("DIMENSION_MISMATCH")
            return [one, two], ["not_georeferenced"], "pixel_assume"
        if both.where(projection.supported(F.lit(one.epsg)) & projection.supported(F.lit(two.epsg))).count() == 0:
            raise Refused("UNSUPPORTED_CRS")
        boxes = []
        for k, s in enumerate((one, two)):
            t = [F.lit(float(x)) for x in s.affine]
            boxes.append(geometry.bbox_to_geo(t, F.lit(0), F.lit(0), F.col(f"w{k}"), F.col(f"h{k}")))
        there = both.withColumn("_t", projection.reprojected_box(boxes[1], F.lit(two.epsg), F.lit(one.epsg)))
        share = there.select(geometry.overlap(boxes[0], [F.col("_t")[x] for x in ("minx", "miny", "maxx", "maxy")]).alias("o")).agg(F.min("o")).first()[0]
        grid = same and one.epsg == two.epsg and tuple(one.affine) == tuple(two.affine)
        judged = self.spark.range(1).select(
            geometry.pair_strategy(F.lit(True), F.lit(share), F.lit(one.epsg == two.epsg), F.lit(grid)).alias("s"), geometry.pair_warning(F.lit(True), F.lit(share)).alias("w")
        ).first()
        if judged["s"] == "incompatible":
            raise Refused("NO_SPATIAL_OVERLAP")
        if judged["s"] != "identical_grid":
            array = lambda t: F.array(*[F.lit(float(x)) for x in t])
            moved = projection.warped(two.pixels, one.pixels.select("scene_id", "r", "c"), two.bands, array(two.affine), array(one.affine), source_epsg=F.lit(two.epsg), target_epsg=F.lit(one.epsg))
            two = Scene(staged(moved), two.bands, two.modality, one.pixel_area, one.north_up, one.affine, one.epsg)
        return [one, two], [judged["w"]] if judged["w"] else [], judged["s"]

    # Steps that several tools share.

    def _optical(self, scenes: list[Scene]) -> Scene:
        return next(s for s in scenes if s.modality != "sar")

    def _classified(self, scene: Scene) -> DataFrame:
        """The class map: spectral with near infrared (and edges, with short-wave infrared), else by colour."""
        px = staged(scene.pixels)
        if "nir" not in scene.bands:
            if not {"red", "green", "blue"} <= set(scene.bands):
                raise Refused("INSUFFICIENT_BANDS")
            return staged(landcover.classify_rgb(px, pixel_area=scene.pixel_area))
        edges = None
        if "swir1" in scene.bands:
            mean = reduce(lambda a, b: a + b, [F.col(b) for b in scene.bands]) / len(scene.bands)
            px, edges = kernels.edge_density(px.withColumn("_mean", mean), "_mean", "edges").drop("_mean"), "edges"
        return staged(landcover.classify(px, scene.bands, edges=edges, pixel_area=scene.pixel_area))

    def _map_facts(self, px: DataFrame) -> DataFrame:
        """scene_id, separability of a class map; null where no index tells."""
        known = [i for i in INDICES if i in px.columns]
        if not {"ndwi", "mndwi"} & set(known):
            return px.select("scene_id").distinct().withColumn("separability", F.lit(None).cast("double"))
        return landcover.mean_separability(px, known)

    def _asked(self, query: str, px: DataFrame) -> DataFrame:
        """The request, once for each scene, under the scene's identifier."""
        return px.select("scene_id").distinct().select("scene_id", F.col("scene_id").alias("request_id"), F.lit(query).alias("query"))

    def _of_map(self, px: DataFrame, figures: DataFrame, said: DataFrame) -> _Found:
        lines = F.array(F.concat(F.lit("mean separability of classes: "), F.format_string("%.2f", "separability")))
        return _Found(figures, said, self._map_facts(px), confidence.for_landcover, lines)

    # Tools.

    def _land_cover(self, query: str, scenes: list[Scene]) -> _Found:
        px = self._classified(scenes[0])
        stats = staged(landcover.class_stats(px, scenes[0].pixel_area))
        rows = px.select("scene_id").distinct().join(answers.by_scene(stats), "scene_id", "left")
        return self._of_map(px, stats, rows.select("scene_id", answers.land_cover_sentence(F.col("classes")).alias("answer")))

    def _caption(self, query: str, scenes: list[Scene]) -> _Found:
        px = self._classified(scenes[0])
        said = staged(answers.captions(landcover.class_stats(px, scenes[0].pixel_area), px.select("scene_id").distinct()))
        return self._of_map(px, said, said.withColumnRenamed("caption", "answer"))

    def _question(self, query: str, scenes: list[Scene]) -> _Found:
        px = self._classified(scenes[0])
        asked = self._asked(query, px)
        read = staged(language.vqa_intent(asked))
        error = read.first()["error"]
        if error:
            raise Refused(error.upper())
        stats = landcover.class_stats(px, scenes[0].pixel_area)
        said = staged(answers.answer_questions(read.join(asked.drop("query"), "request_id"), stats))
        return self._of_map(px, said, said.select(F.col("request_id").alias("scene_id"), "answer"))

    def _ground(self, query: str, scenes: list[Scene]) -> _Found:
        scene = self._optical(scenes)
        px = self._classified(scene)
        known = [i for i in INDICES if i in px.columns]
        asked = self._asked(query, px)
        parsed = staged(language.parse_grounding(asked).join(asked.drop("query"), "request_id"))
        area = scene.pixel_area
        frame = px.groupBy("scene_id").agg(F.count("*").alias("frame_pixels"))
        facts = frame.select("*", F.lit(area is not None).alias("georeferenced"), F.lit(area is not None and scene.north_up).alias("north_up"), F.lit(area).cast("double").alias("pixel_area_m2"))
        admitted = staged(grounding.admitted(parsed, facts))
        error = admitted.first()["error"]
        if error:
            raise Refused(error.upper())
        fused, parted = px, None
        if len(scenes) == 2:
            seen, parted = self._fused(px, scenes)
            fused = px.drop("class_code").join(seen.select("scene_id", "r", "c", F.col("fused_code").alias("class_code")), ["scene_id", "r", "c"])
        scores = {name: landcover.class_score(name, known) for name in landcover.CLASS_INDICES if any(i in known for i in landcover.CLASS_INDICES[name])}
        regions, labels = grounding.class_regions(fused, scores, landcover.min_patch(px, ["scene_id"], area))
        found = staged(grounding.judged(admitted, regions))
        sizes = fused.groupBy("scene_id", landcover.code_name(F.col("class_code")).alias("class")).agg(F.count("*").alias("class_pixels"))
        said = staged(grounding.answers(admitted, found, sizes, parted).withColumnRenamed("request_id", "scene_id"))
        outlines = kernels.polygons(labels.join(found.where("left_out IS NULL").select("scene_id", "class", "label"), ["scene_id", "class", "label"], "left_semi"), by=["scene_id", "class"])
        kept = found.where("left_out IS NULL").select("scene_id", "class", "label", "place", "pixel_area", "area_m2", "sector_overlap", "score", "r0", "c0", "r1", "c1")
        lines = F.array(F.concat(F.lit("regions kept: "), F.col("regions").cast("string")), F.concat(F.lit("pixels of the class: "), F.col("class_pixels").cast("string")))
        more = found.groupBy("scene_id").agg(F.max("more").alias("more"))
        facts = self._map_facts(px).join(said.select("scene_id", "regions", "class_pixels", "count_reportable"), "scene_id").join(more, "scene_id", "left")
        codes = F.array_compact(F.array(F.when(F.col("more"), "more_regions")))
        return _Found(kept.join(outlines, ["scene_id", "class", "label"], "left"), said.select("scene_id", "answer"), facts, confidence.for_grounding, lines, codes)

    def _detected(self, scenes: list[Scene]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The pair by place, its change, its transitions judged by the measured registration, and that."""
        bands = [b for b in scenes[0].bands if b in scenes[1].bands]
        if not bands:
            raise Refused("MISSING_BAND")
        dates = [s.pixels.select("scene_id", F.lit(d).alias("date"), "r", "c", *bands) for s, d in zip(scenes, ("before", "after"), strict=True)]
        pair, area = staged(dates[0].unionByName(dates[1])), scenes[0].pixel_area
        measured = staged(registration.coregister(pair, bands))
        pair = registration.moved(pair, bands, measured)
        last = F.col("last")
        offset = F.hypot(last["offset_x"], last["offset_y"])
        gate = registration.gate(offset, last["ncc"], last["score"])
        gates = staged(measured.select("scene_id", gate["passed"].alias("passed"), last["score"].alias("registration"), offset.alias("offset")))
        if {"nir", "red", "green"} <= set(bands):
            features = tuple(f for f in change.FEATURES if f == "ndvi" or "swir1" in bands) + (() if "swir1" in bands else ("ndwi",))
            both = change.co_grid(landcover.classify(pair, bands, ["scene_id", "date"], pixel_area=area), [*features, "class_code", "valid"])
        else:
            if not {"red", "green", "blue"} <= set(bands):
                raise Refused("INSUFFICIENT_BANDS")
            features = tuple(bands)
            even = staged(change.match_radiometry(pair, bands)).withColumn("date", F.lit("after"))
            pair = pair.where("date = 'before'").select("scene_id", "date", "r", "c", *bands).unionByName(even.select("scene_id", "date", "r", "c", *bands))
            scaled = change.joint_band_stack(pair, bands).drop("magnitude")
            coded = change.co_grid(landcover.classify_rgb(pair, ["scene_id", "date"], area), ["class_code", "valid"])
            both = coded.join(scaled, ["scene_id", "r", "c"])
        both = staged(both)
        if not both.where("valid").head(1):
            raise Refused("NO_JOINT_PIXELS")
        found = staged(change.detect(both, features, area))
        trans = change.transitions(found, area).join(gates, "scene_id", "left")
        return both, found, staged(change.reportable(trans, F.coalesce("passed", F.lit(False))).drop("passed", "registration", "offset")), gates

    def _change_question(self, query: str, scenes: list[Scene]) -> _Found:
        both, found, trans, gates = self._detected(scenes)
        area = F.count_if("changed") * F.lit(scenes[0].pixel_area).cast("double")
        totals = found.groupBy("scene_id").agg(
            F.count_if("changed").alias("changed"), F.count_if("valid").alias("valid"), F.count_if(F.expr("spectral AND by_class")).alias("corroborated"), area.alias("changed_m2"),
            F.max("quality").alias("threshold_quality"),
        )
        totals = staged(totals)
        said = answers.answer_change_questions(self._asked(query, both), totals.drop("threshold_quality"), change.class_deltas(both, scenes[0].pixel_area), trans)
        named = trans.where("reportable").groupBy("scene_id").agg(F.sum("fraction_of_change").alias("attribution"))
        facts = totals.select("scene_id", "changed", "valid", F.coalesce(F.try_divide("corroborated", "changed"), F.lit(1.0)).alias("corroborated"), "threshold_quality")
        facts = facts.join(thresholds.bimodality(found, "magnitude", ["scene_id"]), "scene_id", "left").join(gates, "scene_id", "left").join(named, "scene_id", "left")
        lines = F.array(F.format_string("changed: %d of %d valid pixels", "changed", "valid"), F.format_string("residual offset: %.2f px", "offset"))
        return _Found(trans, said.select(F.col("request_id").alias("scene_id"), "answer"), facts, confidence.for_change, lines)

    def _regimes(self, scene: Scene) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Scattering regimes of the first of vv, vh or another band, their cuts, and the speckle's report."""
        band = next((b for b in ("vv", "vh") if b in scene.bands), scene.bands[0] if scene.bands else None)
        if band is None or scene.pixels.agg(F.count(band).alias("n")).first()["n"] < radar.LEAST_VALID:
            raise Refused("INSUFFICIENT_DATA")
        px = staged(radar.as_power(scene.pixels, band))
        db = staged(radar.despeckle(px, "power"))
        cuts = staged(radar.regime_thresholds(db, "db"))
        return radar.regime_map(db, "db", cuts), cuts, radar.speckle_report(px, "power")

    def _radar(self, query: str, scenes: list[Scene]) -> _Found:
        regimes, cuts, speckle = self._regimes(scenes[0])
        stats = staged(radar.regime_stats(regimes, "db", scenes[0].pixel_area))
        said = scenes[0].pixels.select("scene_id").distinct().join(radar.sentence(stats), "scene_id", "left")
        facts = cuts.select("scene_id", F.nullif(F.greatest("smooth_prominence", "bright_prominence"), F.lit(0.0)).alias("prominence")).join(speckle.select("scene_id", F.col("reduction").alias("speckle_reduction"), "enl"), "scene_id", "left")
        lines = F.array(F.concat(F.lit("equivalent looks: "), F.format_string("%.1f", "enl")))
        return _Found(stats, said.select("scene_id", F.coalesce("answer", F.lit(radar.NOTHING)).alias("answer")), facts, confidence.for_sar, lines)

    def _fused(self, classified: DataFrame, scenes: list[Scene]) -> tuple[DataFrame, DataFrame]:
        """The fused map, and whether radar told bright echoes from the rest of each scene."""
        regimes, cuts, _ = self._regimes(next(s for s in scenes if s.modality == "sar"))
        decides: Column = F.col("_bright")
        parted = cuts.select("scene_id", F.col("bright_db").isNotNull().alias("radar_parts"))
        regimes = regimes.join(parted.withColumnRenamed("radar_parts", "_bright"), "scene_id", "left")
        return staged(radar.fuse(classified, regimes.withColumn("_bright", F.coalesce("_bright", F.lit(False))), decides, ["_bright"])), parted

    def _fusion(self, query: str, scenes: list[Scene]) -> _Found:
        fused, _ = self._fused(self._classified(self._optical(scenes)), scenes)
        stats = staged(radar.fused_stats(fused))
        said = answers.fusion_answers(stats, radar.conflict_groups(fused, None), fused.select("scene_id").distinct())
        both = F.try_divide(F.sum(F.col("corroborated_fraction") * F.col("pixel_count")), F.sum("pixel_count"))
        facts = stats.groupBy("scene_id").agg(both.alias("corroborated")).join(radar.agreement(fused), "scene_id", "left").withColumn("registration", F.lit(None).cast("double"))
        lines = F.array(F.concat(F.lit("agreement of the sensors: "), F.format_string("%.2f", "agreement")))
        return _Found(stats, said, facts, confidence.for_fusion, lines)


__all__ = ["Answer", "Engine", "Refused", "Scene", "ship_package"]
