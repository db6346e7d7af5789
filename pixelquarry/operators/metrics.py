"""Evaluation: masks, boxes, classes, ranked probabilities and stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mask_metrics(df: DataFrame, truth: Column, predicted: Column, by: list[str] = []) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, iou, dice; a ratio without cases is null."""
    counts = df.groupBy(*by).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp, tp + fp + fn).alias("iou"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("dice"))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Shared area of two boxes (x0, y0, x1, y1) over their union."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    areas = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    return F.coalesce(F.try_divide(w * h, areas[0] + areas[1] - w * h), F.lit(0.0))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))


def stratified_split(df: DataFrame, key: str, stratum: str, train: float, validation: float, seed: int = 0) -> DataFrame:
    """``df`` with split: disjoint shares of each stratum, in an order fixed by key and seed.

    Shares are of the stratum's rows, by rank; a stratum's rows are ranked within 1,024 parts of the
    hash and the parts are counted first, so that a large stratum is no single task.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumns({"_h": h, "_part": F.pmod(F.shiftright(h, 40), F.lit(1024))})
    counts = rows.groupBy(stratum, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(stratum))})
    inside = F.row_number().over(Window.partitionBy(stratum, "_part").orderBy("_h", key)) - 1
    ranked = rows.withColumn("_inside", inside).join(counts, [stratum, "_part"]).withColumn("_rank", F.col("_before") + F.col("_inside"))
    split = F.when(F.col("_rank") < F.floor(F.col("_all") * train), "train").when(F.col("_rank") < F.floor(F.col("_all") * (train + validation)), "validation").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def ranked_margin(probabilities: Column) -> tuple[Column, Column, Column]:
    """Best place (from 0), its probability, and its lead over the runner-up."""
    pairs = F.transform(probabilities, lambda p, i: F.struct(p.alias("p"), (-i).alias("i")))
    order = F.sort_array(pairs, asc=False)
    best, second = order[0], F.try_element_at(order, F.lit(2))
    return -best["i"], best["p"], best["p"] - F.coalesce(second["p"], F.lit(0.0))


def best_boxes(truth: DataFrame, predicted: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """by, best (mean over truths of their best overlap), precision and recall at ``least``.

    ``truth`` and ``predicted`` have by, id and box (array of x0, y0, x1, y1); boxes meet within
    their sample. A sample without predictions has recall 0 and no precision.
    """
    corner = lambda b: [F.element_at(F.col(b), k) for k in (1, 2, 3, 4)]
    t, p = (df.select(*by, F.col("id").alias(n), F.col("box").alias(n + "_box")) for df, n in ((truth, "t"), (predicted, "p")))
    pairs = t.join(p, by, "full").withColumn("iou", box_iou(corner("t_box"), corner("p_box")))
    best = lambda n: pairs.where(F.col(n).isNotNull()).groupBy(*by, n).agg(F.max(F.coalesce("iou", F.lit(0.0))).alias("iou"))
    hit = F.avg((F.col("iou") >= least).cast("int"))
    recall = best("t").groupBy(*by).agg(F.avg("iou").alias("best"), hit.alias("recall"))
    return recall.join(best("p").groupBy(*by).agg(hit.alias("precision")), by, "left").select(*by, "best", "precision", "recall")


def class_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """label, centre: the mean vector of each class, of which a linear head is made."""
    tall = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("at", "x"))
    means = tall.groupBy(label, "at").agg(F.avg("x").alias("x"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("centre"))


def linear_head(df: DataFrame, vector: str, centres: DataFrame, label: str) -> DataFrame:
    """``df`` with ranked: array of (probability, name) of every class, most probable first.

    The score of a class is w x + b with w its centre and b minus half its squared length, over the
    whole vector: the nearest centre scores best. Probabilities are the softmax of the scores. The
    centres, a row a class, are one row's array, which every vector meets.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    heads = centres.select(F.struct(F.col(label).alias("name"), F.col("centre").alias("w"), (-dot(F.col("centre"), F.col("centre")) / 2).alias("b")).alias("h"))
    heads = heads.agg(F.sort_array(F.collect_list("h")).alias("_heads"))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(heads.withColumn("_one", F.lit(1))), "_one")
    scores = F.transform("_heads", lambda h: dot(h["w"], F.col(vector)) + h["b"])
    rows = rows.withColumn("_p", softmax(scores))
    pairs = F.zip_with("_p", "_heads", lambda p, h: F.struct((-p).alias("o"), h["name"].alias("name")))
    ranked = F.transform(F.array_sort(pairs), lambda x: F.struct((-x["o"]).alias("probability"), x["name"].alias("name")))
    return rows.withColumn("ranked", ranked).drop("_one", "_heads", "_p")


def exact_match(a: Column, b: Column) -> Column:
    """Whether two answers are equal but for case and outer blanks."""
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False))
