"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets. The longest bucket gives each query a first
lower bound of its k-th score. A bucket is fetched for a block of queries only if its longest
vector could reach the bound of one of them. Inside, the bound over both lengths is a local cosine
threshold: a high one prunes by the coordinates that matter most to the query, a low one by length
alone; what is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm.common import staged

#: Vectors of one bucket, and queries of one block, at most.
BUCKET, QUERIES = 4096, 1024
#: Local cosine thresholds from here on prune by coordinates, lower ones by length.
COORDINATES_FROM, FOCUS = 0.6, 3
#: Parts that pair making is dealt over.
SALTS = 64
_SLACK = 1e-9
_BLOCK_DDL = "block long, dim int, longest double, ids binary, keys binary, rows binary"


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """floor(scale * x) of each component; vectors with a null or non-finite one are left out."""
        names = ["id", "dim", "length", "row"]
        for batch in batches:
            out: list[tuple] = []
            for vec_id, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if vec_id is None or vector is None or None in vector:
                    continue
                x = np.asarray(vector, dtype=np.float64)
                if np.isfinite(x).all():
                    whole = np.floor(scale * x)
                    if np.abs(whole).max(initial=0) >= 2.0**63:
                        raise OverflowError(f"vector {vec_id}: a component times {scale} does not fit in 64 bits")
                    q = whole.astype(np.int64)
                    out.append((vec_id, len(q), float(np.sqrt(np.square(q.astype(np.float64)).sum())), q.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary())
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _packed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut a sorted range into blocks of one dimension."""
        base, count = TaskContext.get().partitionId() << 24, 0
        held: list[tuple[int, int, bytes]] = []
        dim, longest = 0, 0.0
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        names = ["block", "dim", "longest", "ids", "keys", "rows"]

        def block() -> pa.RecordBatch:
            ids, keys = (np.array([h[k] for h in held], dtype=np.int64).tobytes() for k in (0, 1))
            row = (base + count, dim, longest, ids, keys, b"".join(h[2] for h in held))
            return pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for vec_id, own_dim, length, key, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (own_dim != dim or len(held) >= most):
                    yield block()
                    count, held = count + 1, []
                if not held:
                    dim, longest = own_dim, length
                held.append((vec_id, key, row))
        if held:
            yield block()

    return run


def _blocks(vectors: DataFrame, most: int, name: str) -> DataFrame:
    by = [F.col("dim"), F.col("length").desc(), F.col("id")]
    parts = max(1, -(-vectors.count() // most))
    rows = vectors.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("id", "dim", "length", "key", "row")
    return staged(rows.mapInArrow(_packed(most), _BLOCK_DDL), name)


class _Matrix:
    def __init__(self, ids: bytes, keys: bytes, rows: bytes, dim: int) -> None:
        self.ids, self.keys = np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64)
        self.exact = np.frombuffer(rows, np.int64).reshape(len(self.ids), dim)
        self.real = self.exact.astype(np.float64)
        self.length = np.sqrt(np.square(self.real).sum(axis=1))


def _products(q: _Matrix, which: np.ndarray, p: _Matrix, rows: np.ndarray | slice) -> np.ndarray:
    """Exact inner products: in doubles while every sum fits in their 53 bits, else in integers.

    A sum of products is at most the product of the lengths, so 64 bits hold it while they hold that;
    beyond, sums are worked out without bounds and refused if they don't fit.
    """
    most = float(np.abs(q.real[which]).max(initial=0)) * float(np.abs(p.real[rows]).max(initial=0)) * max(1, q.real.shape[1])
    if most < 2.0**53:
        return (q.real[which] @ p.real[rows].T).astype(np.int64)
    if float(q.length[which].max(initial=0)) * float(p.length[rows].max(initial=0)) < 2.0**62:
        return q.exact[which] @ p.exact[rows].T
    found = q.exact[which].astype(object) @ p.exact[rows].T.astype(object)
    if max(abs(x) for x in found.flat) >= 2**63:
        raise OverflowError("an inner product does not fit in 64 bits")
    return found.astype(np.int64)


def _best(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, own: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows but the query's own, which its key tells: rows that share its identifier count."""
    able = np.flatnonzero((scores >= least) & (keys != own))
    order = able[np.lexsort((ids[able], -scores[able]))][:k]
    return ids[order], scores[order]


def search_bucket(q: _Matrix, bound: np.ndarray, p: _Matrix, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query, by its place: the identifiers and scores of up to k vectors that may count.

    Vectors are sorted by length, longest first. A score below ``bound`` never counts.
    """
    need = np.where(q.length > 0, bound / np.maximum(q.length, 1e-300), np.where(bound <= 0, -np.inf, np.inf))
    able = np.flatnonzero(p.length[0] * (1 + _SLACK) + _SLACK >= need)
    local = np.clip(need[able] / max(p.length[0], 1e-300), -1, 1)
    by_length = able[local < COORDINATES_FROM]
    if len(by_length):
        far = int((p.length * (1 + _SLACK) + _SLACK >= need[by_length].min()).sum())
        scores = _products(q, by_length, p, slice(0, far))
        for i, row in zip(by_length.tolist(), scores, strict=True):
            yield i, *_best(p.ids[:far], p.keys[:far], row, q.keys[i], bound[i], k)
    unit = p.real / np.maximum(p.length, 1e-300)[:, None]
    for i in able[local >= COORDINATES_FROM].tolist():
        far = int((p.length * (1 + _SLACK) + _SLACK >= need[i]).sum())
        theta = min(1.0, max(-1.0, need[i] / p.length[0]))
        own = q.real[i] / q.length[i]
        left = np.ones(far, dtype=bool)
        for f in np.argsort(-np.abs(own))[:FOCUS]:
            middle, reach = own[f] * theta, np.sqrt(max(0.0, 1 - own[f] ** 2) * max(0.0, 1 - theta**2))
            # Cosines from theta up to one: the far end of the range is that of the widest cone.
            low = -1.0 if own[f] < -theta else middle - reach
            high = 1.0 if own[f] > theta else middle + reach
            left &= (unit[:far, f] >= low - 1e-7) & (unit[:far, f] <= high + 1e-7)
        rows = np.flatnonzero(left)
        if len(rows):
            scores = _products(q, np.array([i]), p, rows)[0]
            yield i, *_best(p.ids[rows], p.keys[rows], scores, q.keys[i], bound[i], k)


def _bounds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's k-th score in the first bucket, and the length that its block needs."""
        for batch in batches:
            for row in batch.to_pylist():
                q = _Matrix(row["ids"], row["keys"], row["rows"], row["dim"])
                bound = np.full(len(q.ids), -np.inf)
                if row["p_ids"] is not None:
                    p = _Matrix(row["p_ids"], row["p_keys"], row["p_rows"], row["dim"])
                    for i, _, scores in search_bucket(q, bound, p, k):
                        bound[i] = scores[-1] if len(scores) == k else -np.inf
                need = np.where(q.length > 0, bound / np.maximum(q.length, 1e-300), np.where(bound <= 0, -np.inf, np.inf))
                values = (row["block"], row["dim"], float(need.min()), row["ids"], row["keys"], row["rows"], bound.tobytes())
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], type=t) for x, t in zip(values, kinds, strict=True)],
                    names=["q_block", "dim", "need", "q_ids", "q_keys", "q_rows", "bounds"],
                )

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["q_block", "place", "query_id", "vec_id", "score"]
        for batch in batches:
            for row in batch.to_pylist():
                q, p = _Matrix(row["q_ids"], row["q_keys"], row["q_rows"], row["dim"]), _Matrix(row["ids"], row["keys"], row["rows"], row["dim"])
                places, ids, scores = [], [], []
                for i, own_ids, own_scores in search_bucket(q, np.frombuffer(row["bounds"]), p, k):
                    places.append(np.full(len(own_ids), i))
                    ids.append(own_ids), scores.append(own_scores)
                if places:
                    place = np.concatenate(places)
                    columns = [np.full(len(place), row["q_block"]), place, q.ids[place], np.concatenate(ids), np.concatenate(scores)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return run


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best of every query, exactly.

    Components become floor(scale * x). Queries are the rows whose identifier ``every`` divides;
    candidates are all other rows of the same dimension, those that share the identifier, too. Scores are integer inner
    products; ties go to the smaller identifier. A query with fewer candidates gets all of them.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a
    null identifier. Repeated rows are candidates each, and repeated queries get their results
    each. A finite component, scaled, or a score that 64 bits can't hold raises an OverflowError: it
    has no right score of that type. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    quantised = rows.mapInArrow(_quantised(scale), "id long, dim int, length double, row binary")
    quantised = staged(quantised.withColumn("key", F.monotonically_increasing_id()), "topk-vectors")
    buckets = _blocks(quantised, BUCKET, "topk-buckets")
    queries = _blocks(quantised.where(F.col("id") % every == 0), QUERIES, "topk-queries")

    # The first bucket of each dimension: BUCKET vectors at most, so its size is known.
    longest = Window.partitionBy("dim").orderBy("block")
    heads = buckets.select("block", "dim", F.row_number().over(longest).alias("n")).where("n = 1").select("block")
    first = buckets.join(F.broadcast(heads), "block").select("dim", F.col("ids").alias("p_ids"), F.col("keys").alias("p_keys"), F.col("rows").alias("p_rows"))
    bounded = queries.join(F.broadcast(first), "dim", "left").mapInArrow(
        _bounds(k), "q_block long, dim int, need double, q_ids binary, q_keys binary, q_rows binary, bounds binary"
    )
    bounded = staged(bounded, "topk-bounds")

    salted = bounded.select("q_block", "dim", "need", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    summary = buckets.select("block", "dim", "longest", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    reached = F.col("longest") * (1 + _SLACK) + _SLACK >= F.col("need")
    pairs = salted.join(summary, ["dim", "salt"]).where(reached).select("q_block", "block")
    loaded = pairs.join(buckets.select("block", "ids", "keys", "rows"), "block").join(bounded, "q_block")
    columns = ["q_block", "dim", "q_ids", "q_keys", "q_rows", "bounds", "ids", "keys", "rows"]
    found = loaded.repartition("q_block", "block").select(*columns).mapInArrow(
        _search(k), "q_block long, place long, query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("q_block", "place").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
