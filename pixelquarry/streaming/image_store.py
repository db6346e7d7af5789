"""The image store: uploads that are accepted, each content once, however often a batch is run.

A micro-batch writes its new rows to a folder of its own number, and overwrites that; so a batch that failed
half-way or is played again leaves what one run leaves. Contents are told by their SHA-256: within a
batch the first path stands for equal ones, and what an earlier batch stored is left out by an anti-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelquarry.sources import blocks, geotiff
from pixelquarry.sources.sinks import png
from pixelquarry.streaming.uploads import MAX_BYTES, SCHEMA

#: Endings that are let in, with the first bytes that such a file has (fixed values).
ALLOWED = {"tif": (b"II*\0", b"MM\0*"), "tiff": (b"II*\0", b"MM\0*"), "png": (b"\x89PNG\r\n\x1a\n",)}
#: Longer edge of a preview.
PREVIEW = 64
STORED = "path string, sha256 string, length long, width int, height int, band_count int, preview binary, error_code string"


def preview(content: bytes) -> bytes | None:
    """A small PNG of a TIFF's first band, or of its first three, stretched over its own range."""
    tags = geotiff.parse(content)
    bands = [grid for _, grid in blocks.decimated(content, tags, geotiff.sample_kind(tags), PREVIEW)]
    shown = []
    for grid in bands[:3] if len(bands) >= 3 else bands[:1] * 3:
        low, high = (np.nanpercentile(grid, q) if np.isfinite(grid).any() else 0.0 for q in (2, 98))
        part = np.clip((np.nan_to_num(grid, nan=low) - low) / max(high - low, 1e-12), 0, 1)
        shown.append(np.floor(part * 255).astype(np.uint8))
    return png(np.stack(shown, axis=2))


def judged(path: str, length: int, content: bytes) -> dict:
    """One row of ``STORED`` but for its digest; a file that isn't let in says why and has no preview."""
    row = dict.fromkeys(n.split()[0] for n in STORED.split(", ")) | {"path": path, "length": length}
    starts = ALLOWED.get(path.rsplit(".", 1)[-1].lower())
    if starts is None:
        return row | {"error_code": "UNSUPPORTED_TYPE"}
    if length > MAX_BYTES:
        return row | {"error_code": "FILE_TOO_LARGE"}
    if not content.startswith(starts):
        return row | {"error_code": "EMPTY_FILE" if not content else "CONTENT_MISMATCH"}
    if starts[0].startswith(b"\x89"):
        width, height = (int.from_bytes(content[k : k + 4], "big") for k in (16, 20))
        return row | {"width": width, "height": height, "band_count": {0: 1, 2: 3, 4: 2, 6: 4}.get(content[25] if len(content) > 25 else -1)}
    try:
        meta = geotiff.metadata(path, content)
        return row | {k: meta[k] for k in ("width", "height", "band_count", "error_code")} | {"preview": None if meta["error_code"] else preview(content)}
    except ValueError as broken:
        return row | {"error_code": str(broken)}


def read_uploads(files: DataFrame) -> DataFrame:
    """Rows of ``STORED`` for files (path, length, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [judged(p, n, c) | {"sha256": s} for p, n, c, s in zip(part["path"], part["length"], part["content"], part["sha256"])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in STORED.split(", ")]).astype({"width": "Int32", "height": "Int32", "band_count": "Int32"})

    small = F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(F.lit(b""))
    return files.select("path", "length", small.alias("content"), F.sha2("content", 256).alias("sha256")).mapInPandas(run, STORED)


class ImageStore:
    """Accepted images as a Parquet table, a folder for each batch that brought some."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(folder.getFileSystem(conf).exists(folder))

    def all(self) -> DataFrame:
        """Every stored image and the number of its batch; none before the first."""
        schema = STORED + ", batch long"
        return self.spark.read.schema(schema).parquet(self.path) if self._exists() else self.spark.createDataFrame([], schema)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Store what is accepted and new; running a batch again changes nothing."""
        earlier = self.all().where(F.col("batch") < batch).select("sha256")
        accepted = rows.where("error_code IS NULL")
        first = accepted.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in accepted.columns if c != "sha256"]), "path").alias("r"))
        fresh = first.select("r.*", "sha256").join(earlier, "sha256", "left_anti")
        fresh.select(*[x.split()[0] for x in STORED.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def follow(self, folder: str, checkpoint: str, refused: str | None = None) -> StreamingQuery:
        """Store what ``folder`` holds and gets, until nothing is new; refusals go to ``refused``, a table."""
        files = self.spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)

        def run(batch: DataFrame, number: int) -> None:
            rows = read_uploads(batch).persist()
            self.merge(rows, number)
            if refused:
                rows.where("error_code IS NOT NULL").drop("preview").write.mode("overwrite").parquet(f"{refused}/batch={number}")
            rows.unpersist()

        return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
