"""A linear probe over supplied vectors: mini-batch AdamW whose gradients Spark sums up.

Rows are dealt to batches by their key and written as one table, a folder a batch, so a step reads its own rows
alone. A task adds up its rows' gradients, Spark adds up those of tasks by position, and what comes to the driver in
a step is one number a class and component. Each row's share is rounded to a multiple of 2^-24 before it is
added, so sums are exact and a rerun gives the same probe however rows lie in files and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.operators.staging import discard, staged_at

#: Bounds of what the driver and a task hold: classes, and classes times components.
MAX_CLASSES, MAX_WEIGHTS = 10_000, 4_000_000
#: Largest size of a component, so that a task's sums stay exact.
MAX_COMPONENT = 1e6
UNIT = 2.0**24
#: Tasks that write one batch, at most.
SPREAD = 256
BETAS, EPSILON = (0.9, 0.999), 1e-8


@dataclass
class Probe:
    """Classes in ascending order, a row of weights for each (the last one its bias), and what each epoch came to."""

    classes: list
    weights: np.ndarray
    losses: list[float]
    epoch: int


def usable(vector: Column, length: int | None = None) -> Column:
    """Whether a vector is there, has no null and no value that isn't finite, and is of ``length``."""
    sound = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    right = F.size(vector) == length if length else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & sound & right, F.lit(False))


def _chunks(table: pa.RecordBatch, length: int, weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows in pieces of bounded size: which, their vectors with a one behind, their scores."""
    x = table.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    step = max(1, (1 << 20) // weights.size)
    for k in range(0, len(x), step):
        part = np.pad(x[k : k + step], ((0, 0), (0, 1)), constant_values=1.0)
        yield slice(k, k + step), part, (part[:, None, :] * weights[None]).sum(axis=2)


def shares(x: np.ndarray, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows' gradients (rows, classes, components) and losses, in units."""
    away = scores - scores.max(axis=1, keepdims=True)
    powers = np.exp(away)
    total = powers.sum(axis=1, keepdims=True)
    miss = powers / total
    miss[np.arange(len(y)), y] -= 1.0
    loss = np.log(total[:, 0]) - away[np.arange(len(y)), y]
    return np.rint(miss[:, :, None] * x[:, None, :] * UNIT).astype(np.int64), np.rint(loss * UNIT).astype(np.int64)


def _summed(rows: DataFrame, weights: np.ndarray, gradient: bool) -> tuple[np.ndarray | None, float, int]:
    """Mean gradient and loss of ``rows`` (x, y), and their number."""
    length = weights.shape[1] - 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss, n = np.zeros(weights.shape, dtype=np.int64), 0, 0
        for part in parts:
            y = part.column("y").to_numpy()
            for at, x, scores in _chunks(part, length, weights):
                own, lost = shares(x, scores, y[at])
                sums, loss, n = sums + own.sum(axis=0), loss + int(lost.sum()), n + len(x)
        flat = np.concatenate([[n, loss], sums.reshape(-1) if gradient else []]).astype(np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "v"])

    sums = rows.select("x", "y").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["at"]: int(r["v"]) for r in sums.collect()}
    n = found.get(0, 0)
    if not n:
        return None, 0.0, 0
    mean = np.array([found[k + 2] for k in range(weights.size)], dtype=object).reshape(weights.shape) / n if gradient else None
    return None if mean is None else mean.astype(np.float64) / UNIT, found[1] / n / UNIT, n


class AdamW:
    """Adam with weight decay of its own; biases don't decay."""

    def __init__(self, shape: tuple[int, int], rate: float, decay: float) -> None:
        self.rate, self.decay, self.t = rate, decay, 0
        self.first, self.second = np.zeros(shape), np.zeros(shape)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.first = BETAS[0] * self.first + (1 - BETAS[0]) * gradient
        self.second = BETAS[1] * self.second + (1 - BETAS[1]) * gradient**2
        drift = self.first / (1 - BETAS[0] ** self.t) / (np.sqrt(self.second / (1 - BETAS[1] ** self.t)) + EPSILON)
        shrunk = weights.copy()
        shrunk[:, :-1] *= 1 - self.rate * self.decay
        return shrunk - self.rate * drift


def batch_order(seed: int, epoch: int, batches: int) -> list[int]:
    return np.random.default_rng([seed, epoch]).permutation(batches).tolist()


def fit(train: DataFrame, vector: str, label: str, key: str, epochs: int = 3, batches: int = 16, rate: float = 0.05, decay: float = 0.01, seed: int = 1) -> Probe:
    """The probe of the epoch with the least loss on a tenth of the rows, taken out by their key.

    Rows without a label or a sound vector take no part, nor do vectors of another length than most have (ties: the
    longer one). A batch is a share of the rows and not a number of them, so steps don't grow with the data. Equal losses: the
    earlier epoch; no row to validate on: the last one. No usable row, too many classes or a component over
    ``MAX_COMPONENT`` are refused.
    """
    spark = train.sparkSession
    sound = train.where(F.col(label).isNotNull() & usable(F.col(vector)))
    largest = F.max(F.array_max(F.transform(vector, lambda v: F.abs(v.cast("double")))))
    lengths = sound.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"), largest.alias("size"))
    _, length, size = lengths.select("n", "length", "size").orderBy(F.desc("n"), F.desc("length")).first() or (0, 0, 0.0)
    classes = sorted(r[0] for r in sound.where(F.size(vector) == length).select(label).distinct().limit(MAX_CLASSES + 1).collect())
    if not classes or len(classes) > MAX_CLASSES or len(classes) * (length + 1) > MAX_WEIGHTS or size > MAX_COMPONENT:
        raise ValueError("no usable rows" if not classes else f"{len(classes)} classes of {length} components up to {size}: over the bounds")
    known = spark.createDataFrame([(c, k) for k, c in enumerate(classes)], f"`{label}` {train.schema[label].dataType.simpleString()}, y int")
    x = F.transform(vector, lambda v: v.cast("double")).alias("x")
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.lit(n))
    batch = F.when(dealt(10, 0) == 0, -1).otherwise(dealt(batches, 1)).cast("int").alias("batch")
    rows = sound.where(F.size(vector) == length).select(x, label, batch, dealt(SPREAD, 2).alias("part")).join(known, label)
    rows, path = staged_at(rows.repartition("batch", "part").select("x", "y", "batch"), ["batch"])

    weights = np.zeros((len(classes), length + 1))
    adam, kept, losses = AdamW(weights.shape, rate, decay), None, []
    for epoch in range(epochs):
        for b in batch_order(seed, epoch, batches):
            gradient, _, n = _summed(rows.where(F.col("batch") == b), weights, True)
            if n:
                weights = adam.step(weights, gradient)
        _, loss, n = _summed(rows.where(F.col("batch") == -1), weights, False)
        losses.append(loss)
        if kept is None or not n or loss < losses[kept[1]]:
            kept = weights, epoch
    discard(spark, path)
    return Probe(classes, kept[0], losses, kept[1])


def predicted(df: DataFrame, vector: str, probe: Probe, kind: str) -> DataFrame:
    """``df`` with predicted: the class of the best score, ties to the smaller one; null without a sound vector of that length."""
    length, weights = probe.weights.shape[1] - 1, probe.weights

    @F.pandas_udf("int")
    def best(vectors: pd.Series) -> pd.Series:
        table = pa.RecordBatch.from_arrays([pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["x"])
        return pd.Series(np.concatenate([s.argmax(axis=1) for _, _, s in _chunks(table, length, weights)] or [np.zeros(0, int)]).astype(np.int32))

    zeros = F.array_repeat(F.lit(0.0), length)
    fits = usable(F.col(vector), length)
    at = best(F.when(fits, F.transform(vector, lambda v: v.cast("double"))).otherwise(zeros))
    names = F.array(*map(F.lit, probe.classes)).cast(f"array<{kind}>")
    return df.withColumn("predicted", F.when(fits, F.element_at(names, at + 1)))


def train_probe(train: DataFrame, test: DataFrame, vector: str, label: str, key: str, **how: float) -> DataFrame:
    """``test`` with predicted, by a probe fitted on ``train``; ``how`` as in ``fit``."""
    return predicted(test, vector, fit(train, vector, label, key, **how), train.schema[label].dataType.simpleString())
