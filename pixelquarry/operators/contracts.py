"""What a request may run on: input modes, sensors, pairs, and the tool that serves a task.

A request is a row with its images' modalities as an array; the tools are a small table it meets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.operators.staging import staged

MOST_IMAGES = 2
#: tool, task, tier, images at least and at most, modes it takes, modalities it needs (fixed values).
TOOLS = (
    ("landcover", "land_cover_analysis", 1, 1, 1, ("single_optical",), ("optical",)),
    ("scene-model", "captioning", 0, 1, 1, ("single_optical",), ("optical",)),
    ("captioning", "captioning", 1, 1, 1, ("single_optical",), ("optical",)),
    ("vqa", "vqa", 1, 1, 1, ("single_optical",), ("optical",)),
    ("grounding", "grounding", 1, 1, 2, ("single_optical", "optical_sar_pair"), ("optical",)),
    ("change", "change_detection", 1, 2, 2, ("bitemporal_pair",), ()),
    ("change-vqa", "change_vqa", 1, 2, 2, ("bitemporal_pair",), ()),
    ("sar", "optical_sar_analysis", 1, 1, 1, ("single_sar",), ("sar",)),
    ("fusion", "optical_sar_analysis", 1, 2, 2, ("optical_sar_pair",), ("optical", "sar")),
)
#: Tasks that are known and not built, and those whose tools may be out (fixed values).
NOT_BUILT = ("object_detection", "segmentation")
#: A refusal on modalities says more than one on modes, and this more than one on numbers.
PRIORITY = ("missing_modality", "wrong_mode", "too_few_images", "too_many_images")


def input_mode(modalities: Column, compatible: Column) -> dict[str, Column]:
    """mode and error of a request's images: none, more than two, or two that can't be compared.

    One image is ``single_sar`` or else ``single_optical``; two are ``optical_sar_pair`` if one of
    each is known, else ``bitemporal_pair``. Null modalities count as no image.
    """
    n = F.coalesce(F.size(modalities), F.lit(0))
    has = lambda m: F.coalesce(F.array_contains(modalities, m), F.lit(False))
    error = F.when(n <= 0, "missing_image").when(n > MOST_IMAGES, "too_many_images").when((n == 2) & ~compatible, "pair_incompatible")
    mode = F.when(n == 1, F.when(has("sar"), "single_sar").otherwise("single_optical"))
    mode = mode.otherwise(F.when(has("sar") & has("optical"), "optical_sar_pair").otherwise("bitemporal_pair"))
    return {"mode": F.when(error.isNull(), mode), "error": error}


def undetermined(modalities: Column, mode: Column) -> Column:
    """The images (from 1) whose sensor nothing told, where a pair is taken for two dates of one sensor;
    an empty array else."""
    places = F.transform(modalities, lambda m, k: F.when(F.coalesce(m, F.lit("unknown")) == "unknown", k + 1))
    none = F.array().cast("array<int>")
    return F.when(mode == "bitemporal_pair", F.array_compact(places)).otherwise(none)


def modality_warning(found: Column, expected: Column) -> Column:
    """``undetermined`` or ``mismatch`` where an image isn't known to be of the sensor that a task
    expects; an unknown expectation is met by all."""
    return F.when((expected == "unknown") | (found == expected), F.lit(None)).when(found == "unknown", "undetermined").otherwise("mismatch")


def shares_bands(a: Column, b: Column) -> Column:
    """Whether two scenes have any identified band in common."""
    known = lambda x: F.array_remove(x, "unknown")
    return F.coalesce(F.arrays_overlap(known(a), known(b)), F.lit(False))


def tool_table(spark: SparkSession) -> DataFrame:
    ddl = "tool string, task string, tier int, least int, most int, modes array<string>, needs array<string>"
    rows = [(t, task, tier, lo, hi, list(modes), list(needs)) for t, task, tier, lo, hi, modes, needs in TOOLS]
    return spark.createDataFrame(rows, ddl).withColumn("ord", F.monotonically_increasing_id())


def violation() -> Column:
    """The first rule of a tool's contract that a request breaks: number, then mode, then modality."""
    n = F.size("modalities")
    out = F.when(n < F.col("least"), "too_few_images").when(n > F.col("most"), "too_many_images")
    return out.when(~F.array_contains("modes", F.col("mode")), "wrong_mode").when(F.size(F.array_except("needs", "modalities")) > 0, "missing_modality")


def dispatch(requests: DataFrame, out_of_order: tuple[str, ...] = ()) -> DataFrame:
    """request_id, tool, error: who serves each request (request_id, task, mode, modalities).

    Of the task's tools that are available and take the request, the lowest tier goes first, then
    the order of the table; those of ``out_of_order``, and of a request's own array ``tried`` where it has one,
    are passed over. Else the error: the task isn't built, isn't known, no tool is available, or the most
    telling broken rule.
    """
    tools = F.broadcast(tool_table(requests.sparkSession))
    able = ~F.col("tool").isin(*out_of_order) if out_of_order else F.col("tool").isNotNull()
    if "tried" in requests.columns:
        able = able & ~F.array_contains("tried", F.col("tool"))
    rows = requests.join(tools, "task", "left").withColumns({"broken": violation(), "open": able})
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("broken"))
    found = rows.groupBy("request_id", "task").agg(
        F.min_by("tool", F.when(F.col("open") & F.col("broken").isNull(), F.struct("tier", "ord"))).alias("tool"),
        F.min_by("broken", F.when(F.col("open") & F.col("broken").isNotNull(), F.struct(rank, "tier", "ord"))).alias("broken"),
        F.count("tool").alias("known"),
        F.count_if(F.coalesce("open", F.lit(False))).alias("open"),
    )
    error = F.when(F.col("task").isin(*NOT_BUILT), "unsupported_task").when(F.col("known") == 0, "not_dispatchable").when(F.col("open") == 0, "model_unavailable")
    return found.select("request_id", "tool", F.when(F.col("tool").isNull(), error.otherwise(F.col("broken"))).alias("error"))


def served(requests: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """request_id, tool, answer, tried, error: each request (request_id, task, mode, modalities) by the first tool
    that answers it.

    ``tools`` run on the requests that are sent to them and give request_id and answer; a null or missing
    answer is a failure. Requests that a tool failed enter the dispatch again with that tool among their ``tried``
    ones, until one answers or none is left, for which ``dispatch`` gives the error. There are as many rounds
    as a task has tools, and one for what is left then.
    """
    rounds = 1 + max(Counter(t[1] for t in TOOLS).values())
    waiting = requests.withColumn("tried", F.array().cast("array<string>"))
    done = []
    for _ in range(rounds):
        sent = staged(waiting.join(dispatch(waiting), "request_id"))
        done.append(sent.where("tool IS NULL").select("request_id", "tool", F.lit(None).cast("string").alias("answer"), "tried", "error"))
        ran = reduce(DataFrame.unionByName, [run(sent.where(F.col("tool") == name)).select("request_id", "answer") for name, run in tools.items()])
        judged = staged(sent.where("tool IS NOT NULL").join(ran, "request_id", "left"))
        done.append(judged.where("answer IS NOT NULL").select("request_id", "tool", "answer", "tried", "error"))
        failed = judged.where("answer IS NULL").withColumn("tried", F.concat("tried", F.array("tool")))
        waiting = failed.select(*requests.columns, "tried")
    return reduce(DataFrame.unionByName, done)


def resolved_task(routed: Column, pinned: Column) -> dict[str, Column]:
    """task, and overridden: whether a pinned task (not null, empty or ``auto``) differs from the routed one."""
    held = F.coalesce(pinned, F.lit("")).isin("", "auto")
    return {"task": F.when(held, routed).otherwise(pinned), "overridden": ~held & (pinned != routed)}


def grid_text(georeferenced: Column, epsg: Column) -> Column:
    """How a scene's grid is named."""
    named = F.concat(F.lit("EPSG:"), epsg.cast("string"), F.lit(" grid"))
    return F.when(~georeferenced, "pixel grid (no georeference)").otherwise(F.coalesce(named, F.lit("projected grid (CRS present, EPSG code unresolved)")))
