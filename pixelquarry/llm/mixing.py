"""Mixing sources to target weights by a low-discrepancy source schedule.

Slots are points of the golden-ratio sequence, mapped through the sources' cumulative shares; the
r-th slot of a source takes its r-th block. Blocks hold equally many words of the source's
shuffled documents. Everything is DataFrame functions, and every running sum over a source is cut
in two (within buckets, then over bucket totals), so that one large source is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm.common import WORD, boxed, staged

#: frac(k * this), k = 1, 2, ..., is the golden-ratio sequence.
GOLDEN = 0.6180339887498949
#: Parts that a source's shuffled documents are dealt into for running sums.
BUCKETS = 4096
#: Slots of one stretch of the schedule that are ranked together.
STRETCH = 4096
#: Cells of [0, 1) by which points find their source.
CELLS = 1024


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and shuffle, a fixed pseudo-random order."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit("shuffle"), F.col("doc_id").cast("long"), "text").alias("shuffle"),
    ).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))


def source_targets(totals: DataFrame, ratio: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """Targets in words for ``totals`` (key, source, source_size): water filling under caps.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``ratio`` times all
    words. A target stops at ``most`` times its source's size and the excess is shared again by
    weight. With the sources sorted by cap over weight, those under the water level are a prefix,
    so the level is found with two running sums; there is one row for each source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("weight", F.get(turn, (F.row_number().over(place) - 1) % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "whole": F.sum("source_size").over(everything) * F.lit(float(ratio)),
            "full_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(rest),
        }
    )
    rows = rows.withColumn("level", (F.col("whole") - F.col("full_before")) / F.col("weight_left"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("water", F.max(F.when(fits, F.col("level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return rows.select("key", "source_size", target.alias("target"))


def _running(df: DataFrame, by: list[str], order: list[Column], value: Column) -> Column:
    """Sum of ``value`` over the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _placed(sizes: DataFrame) -> DataFrame:
    """Where each document starts among its source's shuffled words (column ``at``)."""
    rows = sizes.withColumn("bucket", F.pmod("shuffle", F.lit(BUCKETS)))
    totals = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("before", _running(totals, ["key"], [F.col("bucket")], F.col("words"))).drop("words")
    within = [F.col("shuffle"), F.col("doc_id"), F.col("size")]
    rows = rows.withColumns(
        {
            "inside": _running(rows, ["key", "bucket"], within, F.col("size")),
            "n": F.row_number().over(Window.partitionBy("key", "bucket").orderBy(*within)),
        }
    )
    return rows.join(totals, ["key", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """Blocks and slots that each source needs, and its share [lo, hi) of the schedule."""
    size = F.col("source_size")
    rows = targets.withColumn("words", F.floor("target"))
    rows = rows.where((size > 0) & (F.col("words") > 0)).withColumns(
        {"blocks": F.ceil(size / F.lit(block)), "rounds": F.floor(F.col("words") / size)}
    )
    left = F.col("words") - F.col("rounds") * size
    rows = rows.withColumn("need", F.col("rounds") * F.col("blocks") + F.ceil(left / F.lit(block)))
    rows = rows.withColumns(
        {"slots": F.sum("need").over(Window.partitionBy()), "first": _running(rows, [], [F.col("key")], F.col("need"))}
    )
    return rows.withColumns(
        {"lo": F.col("first") / F.col("slots"), "hi": (F.col("first") + F.col("need")) / F.col("slots")}
    ).drop("first")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """key, slot, pass, block, length: which block of which source each slot takes.

    A source's r-th slot takes block r modulo its number of blocks; the last one is cut so that the
    source's words are its target, rounded down. Points that exceed a source's need are passed
    over, and needs that the points leave open (a few slots at most, by the sequence's low
    discrepancy, or a source too small for any point) are appended.
    """
    plan = staged(_plan(targets, block), "mix-plan")
    spark = targets.sparkSession
    slots = plan.agg(F.coalesce(F.max("slots"), F.lit(0)).alias("n")).first()["n"]
    point = (F.col("id") + 1) * F.lit(GOLDEN) % 1
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = plan.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))))
    )
    # A cell has as many rows as there are points in 1/1024 of the schedule: no source heats a key.
    drawn = points.join(cells, "cell").where("point >= lo AND point < hi").select("slot", "key")

    drawn = drawn.withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = drawn.groupBy("key", "stretch").agg(F.count("*").alias("m"))
    counts = counts.withColumn("ranked", _running(counts, ["key"], [F.col("stretch")], F.col("m")))
    in_stretch = F.row_number().over(Window.partitionBy("key", "stretch").orderBy("slot")) - 1
    ranked = drawn.withColumn("r", in_stretch).join(counts.drop("m"), ["key", "stretch"])
    ranked = ranked.select("key", "slot", (F.col("ranked") + F.col("r")).alias("rank"))

    got = counts.groupBy("key").agg(F.sum("m").alias("got"))
    short = plan.join(got, "key", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1)))
    short = short.select("key", (F.col("slots") + F.col("rank")).alias("slot"), "rank")

    rows = ranked.unionByName(short).join(plan, "key").where("rank < need")
    rows = rows.withColumns({"pass": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
    start = F.col("block") * block
    most = F.least(F.lit(block), F.col("source_size") - start)
    length = F.least(most, F.col("words") - F.col("pass") * F.col("source_size") - start)
    return rows.select("key", "slot", "pass", "block", length.alias("length"))


def _mixed(docs: DataFrame, ratio: float, weights: tuple[float, ...], most: float, block_words: int) -> DataFrame:
    """As ``mix_sources``, with ``shuffle`` and ``slots``: where each pass first takes words of it."""
    placed = staged(_placed(staged(document_sizes(docs), "mix-sizes")), "mix-placed")
    sizes = placed.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, ratio, weights, most), "mix-targets")
    slots = schedule(targets, block_words)

    end = F.col("at") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block_words), F.floor((end - 1) / block_words)))
    pieces = placed.select("key", "bucket", "n", "at", end.alias("end"), F.explode(blocks).alias("block"))
    start = F.col("block") * block_words
    pieces = pieces.withColumns({"from": F.greatest(F.col("at") - start, F.lit(0)), "to": F.least(F.col("end") - start, F.lit(block_words))})
    used = pieces.join(slots, ["key", "block"])
    used = used.withColumn("words", F.least("to", "length") - F.col("from")).where("words > 0")
    # A document has one row a pass, and passes are ``most`` at most.
    by_pass = used.groupBy("key", "bucket", "n", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    taken = by_pass.groupBy("key", "bucket", "n").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("slot")).alias("slots"))
    rows = placed.join(taken, ["key", "bucket", "n"], "left").join(targets, "key")
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce(F.size("slots"), F.lit(0)).alias("passes"),
        F.get("slots", F.lit(0)).alias("first_slot"),
        "slots",
        "shuffle",
    )


def mix_sources(
    docs: DataFrame,
    ratio: float = 1.5,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    most: float = 2.0,
    block_words: int = 4096,
) -> DataFrame:
    """Mix ``docs`` so that each source gives its target of words.

    Returns a row for each row of ``docs``: doc_id, source, size, source_size, target (the
    source's), taken (words that the mix takes, repeats counted), passes (in how many passes over
    its source any of its words are taken) and first_slot (the slot of the schedule that first takes
    any; null if none does).

    The order is a hash of identifier and text, so reruns agree; rows that agree in both are
    interchangeable. Null text has size 0 and is never taken; a null source is a source of its own,
    last in order; null identifiers are kept. A document longer than a block lies in several, and
    the last slot of a source may end inside a document. An empty table gives no rows; columns other
    than doc_id, text and source are not read.
    """
    return _mixed(docs, ratio, weights, most, block_words).drop("slots", "shuffle")


def mixed_documents(
    docs: DataFrame,
    ratio: float = 1.5,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    most: float = 2.0,
    block_words: int = 4096,
) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names), each as often as passes of the mix
    take words of it; every partition in the order of the schedule.

    A document that the mix enters is emitted whole, at the slot that first takes words of it in
    that pass. Documents are dealt over partitions by hash, so that each partition is a mix like the
    whole, and texts move once. Rows that agree in identifier and text are paired with their verdicts by number, so
    repeated rows stay apart. Edge cases as ``mix_sources``: what has no words is never taken.
    """
    keys = ["shuffle", "id", "no_id"]
    keyed = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "no_id": F.isnull("doc_id")}
    mixed = _mixed(docs, ratio, weights, most, block_words).withColumns(keyed)
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(F.size("slots").desc(), "slots"))
    verdicts = mixed.withColumn("n", numbered).where("passes > 0").select(*keys, "n", "slots")
    rows = boxed(docs, shuffle=F.xxhash64(F.lit("shuffle"), F.col("doc_id").cast("long"), "text"), **keyed)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).join(verdicts, [*keys, "n"])
    emitted = rows.select("row", F.explode("slots").alias("slot"), "shuffle")
    return emitted.sortWithinPartitions("slot", "shuffle").select("row.*")
