"""Centroid clustering through a vantage-point tree over the centroids.

Each round builds a tree over the centroids, a bounded number of them, and broadcasts it. Every
vector searches it best-first: of the nodes that may still hold its nearest centroid it opens the
one with the least lower bound, and it is done when no bound is within its best distance. Tasks
do this for a batch of vectors at a time, each with bounds of its own. Bounds are real numbers with
some slack and are inclusive, so ties reach the leaves; distances there are exact integers, and of
equal ones the smaller number wins. A task adds up its own vectors, so what is shuffled is a row a
cluster, component and task, and no cluster is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm.common import staged

#: Centroids of a leaf, vectors searched together, and the share of a bound that rounding may take.
LEAF, BATCH, SLACK = 2, 8192, 1e-9
#: Components up to this size have differences whose squares 64 bits hold.
_SMALL = 2**27


@dataclass
class Tree:
    """Nodes in depth-first order. A node has a vantage point or, at a leaf, its centroids.

    ``inner`` and ``outer`` are its children, -1 for none; ``reach`` has the least and greatest
    distance from the vantage point to what each child holds, inner and then outer.
    """

    centroids: np.ndarray
    vantage: list[int]
    inner: list[int]
    outer: list[int]
    reach: list[tuple[float, float, float, float]]
    leaf: list[list[int]]


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one; raises where 64 bits can't hold one."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroid).max(initial=0)))
    if most <= _SMALL and vectors.shape[1] <= 127:
        return np.square(vectors - centroid).sum(axis=1)
    apart = vectors.astype(object) - centroid.astype(object)
    found = (apart * apart).sum(axis=1)
    if any(x >= 2**63 for x in found):
        raise OverflowError("a squared distance does not fit in 64 bits")
    return found.astype(np.int64)


def build_tree(centroids: np.ndarray) -> Tree:
    """A vantage-point tree; equal centroids lie in it one by one, so ties see all numbers."""
    tree = Tree(centroids, [], [], [], [], [])
    real = centroids.astype(np.float64)

    def grow(members: list[int]) -> int:
        if not members:
            return -1
        own = len(tree.vantage)
        for part, empty in ((tree.vantage, -1), (tree.inner, -1), (tree.outer, -1), (tree.reach, (0.0,) * 4), (tree.leaf, [])):
            part.append(empty)
        if len(members) <= LEAF:
            tree.leaf[own] = members
            return own
        # The vantage point is the member that is farthest from the members' mean: it spreads the others.
        middle = real[members].mean(axis=0)
        vantage = members[int(np.argmax(np.square(real[members] - middle).sum(axis=1)))]
        others = [m for m in members if m != vantage]
        distance = np.sqrt(np.square(real[others] - real[vantage]).sum(axis=1))
        order = np.argsort(distance, kind="stable")
        half = (len(others) + 1) // 2
        near, far = order[:half], order[half:]
        reach = [distance[near].min(), distance[near].max(), *((distance[far].min(), distance[far].max()) if len(far) else (0.0, 0.0))]
        tree.vantage[own], tree.reach[own] = vantage, tuple(float(x) for x in reach)
        tree.inner[own] = grow([others[i] for i in near])
        tree.outer[own] = grow([others[i] for i in far])
        return own

    grow(list(range(len(centroids))))
    return tree


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number (the smaller of equals) and squared distance of each row."""
    rows = np.arange(len(vectors))
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    number = np.full(len(vectors), len(tree.centroids))
    # Lower bounds of the nodes that a vector hasn't opened and may have to; infinite for others.
    bound = np.full((len(vectors), len(tree.vantage)), np.inf)
    bound[:, 0] = 0.0

    def tried(at: np.ndarray, centroid: int) -> np.ndarray:
        distance = squared(vectors[at], tree.centroids[centroid])
        better = (distance < best[at]) | ((distance == best[at]) & (centroid < number[at]))
        best[at[better]], number[at[better]] = distance[better], centroid
        return distance

    while len(rows):
        node = np.argmin(bound[rows], axis=1)
        least = bound[rows, node]
        # Inclusive: a node at just the best distance may hold an equal one with a smaller number.
        open_ = np.isfinite(least) & (least * (1 - SLACK) - SLACK <= np.sqrt(best[rows].astype(np.float64)))
        rows, node = rows[open_], node[open_]
        for k in np.unique(node):
            at = rows[node == k]
            bound[at, k] = np.inf
            for centroid in tree.leaf[k]:
                tried(at, centroid)
            if tree.vantage[k] < 0:
                continue
            distance = np.sqrt(tried(at, tree.vantage[k]).astype(np.float64))
            low_in, high_in, low_out, high_out = tree.reach[k]
            for child, low, high in ((tree.inner[k], low_in, high_in), (tree.outer[k], low_out, high_out)):
                if child >= 0:
                    bound[at, child] = np.maximum(0.0, np.maximum(low - distance, distance - high))
    return number, best


def _searched(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    dim = tree.centroids.shape[1]
    for batch in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
        vectors = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, dim)
        yield batch, vectors, *nearest(tree, vectors)


def _sums(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each cluster that this task has met: its count and its components' sums."""
        tree = shared.value
        k, dim = tree.centroids.shape
        counts, sums = [0] * k, [[0] * dim for _ in range(k)]
        for _, vectors, number, _ in _searched(batches, tree):
            for cluster in np.unique(number).tolist():
                own = vectors[number == cluster]
                # A batch's sum fits where components are small; what runs over batches has no bound.
                added = own.sum(axis=0) if np.abs(own).max() < 2**49 else own.astype(object).sum(axis=0)
                counts[cluster] += len(own)
                sums[cluster] = [a + b for a, b in zip(sums[cluster], added.tolist())]
        met = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array([counts[c] for c in met], pa.int64()), pa.array([[str(x) for x in sums[c]] for c in met], pa.list_(pa.string()))],
            names=["cluster", "n", "sums"],
        )

    return run


def _assigned(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, distance in _searched(batches, shared.value):
            columns = [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return run


def quantised(vector: Column, scale: int, dim: int) -> Column:
    """floor(scale * x) of each component as long; null unless there are ``dim``, all finite."""
    doubles = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0**62)
    too_large = F.raise_error(F.lit("a component does not fit in 64 bits")).cast("array<bigint>")
    return F.when(usable & small, doubles).when(usable, too_large)


def _centroids_after(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean, exactly; a centroid without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(build_tree(centroids))
    partial = vectors.select("q").mapInArrow(_sums(shared), "cluster int, n long, sums array<string>")
    parts = partial.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    total = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    after = centroids.copy()
    for row in total.collect():  # a row for each centroid and component
        after[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    shared.destroy()
    return after


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector.

    Components become floor(scale * x). Centroids start as the ``k`` vectors with the least sha256 of
    ``seed:vec_id``; ``rounds`` times vectors go to their nearest centroid (ties: smaller number) and
    each centroid becomes the floor of its vectors' mean, or stays if it has none; then vectors are
    assigned once more. Inertia is the distance summed over a cluster, and over all.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. Rows
    with a null identifier are clustered but never start a centroid. Repeated rows count each; equal
    hashes are ordered by components. Fewer vectors than ``k`` give fewer centroids, and centroids may
    be equal. A component or distance that 64 bits can't hold raises. Without a vector that can
    start a centroid, as in an empty table, no rows come back; other columns are not read.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale, dim).alias("q")).where("q IS NOT NULL")
    rows = staged(usable, "clustering-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").select("q", order.alias("h")).orderBy("h", "q").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = np.array([row["q"] for row in first], dtype=np.int64)
    for _ in range(rounds):
        centroids = _centroids_after(rows, centroids)

    shared = rows.sparkSession.sparkContext.broadcast(build_tree(centroids))
    found = staged(rows.mapInArrow(_assigned(shared), "vec_id long, cluster int, distance long"), "clustering-assigned")
    text = [(c, ",".join(map(str, row))) for c, row in enumerate(centroids.tolist())]
    digests = vectors.sparkSession.createDataFrame(text, "cluster int, text string").select("cluster", F.sha2("text", 256).alias("centroid_sha256"))
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))  # of k rows at most
    facts = own.join(digests, "cluster").withColumn("inertia", whole)
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
