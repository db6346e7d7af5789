"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal texts next
to each other, and a streaming pass compares each text in full with its neighbour. The splitters
include the identifier, so one large group of copies is dealt over as many partitions as its size
needs; the runs that touch a partition's edge are then merged by full text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquarry.llm.common import boxed, staged

#: Characters of a text that a splitter holds; the driver gets splitters, never whole texts.
HEAD = 32
_RUNS = pa.schema(
    [
        ("id", pa.int64()),
        ("run", pa.int64()),
        ("best", pa.int64()),
        ("members", pa.int64()),
        ("first", pa.bool_()),
        ("text_sha256", pa.string()),
        ("edge", pa.bool_()),
        ("text", pa.string()),
    ]
)
_RUNS_DDL = (
    "id long, run long, best long, members long, first boolean, text_sha256 string, "
    "edge boolean, text string"
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted partition: a row for each document.

    A run is an ``edge`` run if its sort key is the first or the last of the partition: only such
    runs can go on in another partition. Of a run, identifiers alone are held.
    """
    base = TaskContext.get().partitionId() << 32
    seq, first_key, key, text = 0, None, None, None
    ids: list[int | None] = []
    waiting: list[tuple[int, list[int | None], str]] = []  # complete runs of the present key
    out: dict[str, list] = {name: [] for name in _RUNS.names}

    def put(run: int, members: list[int | None], content: str, edge: bool) -> None:
        n, digest = len(members), hashlib.sha256(content.encode()).hexdigest()
        out["id"] += members
        out["run"] += [run] * n
        out["best"] += [members[0]] * n
        out["members"] += [n] * n
        out["first"] += [True] + [False] * (n - 1)
        out["text_sha256"] += [digest] * n
        out["edge"] += [edge] * n
        out["text"] += [content if edge else None] + [None] * (n - 1)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(out, schema=_RUNS)
        for values in out.values():
            values.clear()
        return batch

    for batch in batches:
        heads, hashes, texts, row_ids = (c.to_pylist() for c in batch.columns)
        for head, hashed, content, row_id in zip(heads, hashes, texts, row_ids, strict=True):
            if content == text:
                ids.append(row_id)
                continue
            if ids:
                waiting.append((base + seq, ids, text))
                seq += 1
            if (head, hashed) != key:
                for run in waiting:
                    put(*run, edge=key == first_key)
                waiting = []
                key = (head, hashed)
                first_key = first_key or key
            ids, text = [row_id], content
            if len(out["id"]) >= 8192:
                yield flush()
    if ids:
        waiting.append((base + seq, ids, text))
    for run in waiting:
        put(*run, edge=True)
    if out["id"]:
        yield flush()


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "min",
) -> DataFrame:
    """Groups of equal texts; ``keep`` says whether the smallest or largest identifier stays.

    Returns a row for each row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.
    ``normalise`` maps the text column before texts are compared (default: no change).

    A null text counts as empty, and empty texts are equal to each other. Null identifiers come
    last: a group keeps one only if it has no other, and keep_id is then null. Of repeated rows
    (same identifier and text) exactly one is kept. An empty table gives no rows; columns other
    than the two named are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.coalesce(normalise(text), F.lit("")) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.select(F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("hash"), "text", "id")
    by_id = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    ordered = rows.repartitionByRange("head", "hash", by_id).sortWithinPartitions("head", "hash", "text", by_id)
    runs = staged(ordered.mapInArrow(_runs, _RUNS_DDL), "exact-dedup-runs")

    # At most a few runs for each partition; the join sends back identifiers and counts only. As a table
    # they have a known size, by which Spark broadcasts them or not.
    same = Window.partitionBy("text")
    merged = runs.where("edge AND first").select(
        "run",
        F.min_by("best", "run").over(same).alias("all_best"),
        F.sum("members").over(same).alias("all_members"),
        F.min("run").over(same).alias("first_run"),
    )
    merged = staged(merged, "exact-dedup-edges")
    return runs.join(merged, "run", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("edge"), F.col("all_best")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("all_members", "members").alias("group_size"),
        (F.col("first") & (F.coalesce("first_run", "run") == F.col("run"))).alias("kept"),
        "text_sha256",
    )


def kept_documents(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that exact dedup keeps.

    A row is found again by identifier (null-safe) and content hash; of repeated rows one stays.
    Edge cases as ``exact_dedup``. The join and the last step have the same keys, so the texts move
    once.
    """
    keys = ["id", "no_id", "sha"]
    verdict = exact_dedup(docs, keep=keep).where("kept")
    verdict = verdict.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"), F.col("text_sha256").alias("sha"))
    tagged = boxed(
        docs,
        id=F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        no_id=F.isnull("doc_id"),
        sha=F.sha2(F.coalesce("text", F.lit("")), 256),
    )
    return tagged.join(verdict, keys, "left_semi").dropDuplicates(keys).select("row.*")
