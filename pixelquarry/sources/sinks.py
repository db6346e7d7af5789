"""Sinks: PNG images, data URIs, GeoJSON, HTML reports and the record store."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.operators.language import html_escape
from pixelquarry.operators.staging import staged
from pixelquarry.sources import allocation


def png(image: np.ndarray) -> bytes:
    """A gray (h, w) or colour (h, w, 3) array of bytes as PNG."""
    h, w = image.shape[:2]
    rows = b"".join(b"\0" + image[r].tobytes() for r in range(h))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def render(px: DataFrame, channels: list[str], scene: str = "scene_id") -> DataFrame:
    """scene and png: each scene's channels (bytes 0..255; one is gray, three are colour)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(rows["r"].max()) + 1, int(rows["c"].max()) + 1, len(channels)), dtype=np.uint8)
        image[rows["r"], rows["c"]] = rows[channels].fillna(0).to_numpy()
        return pd.DataFrame({scene: [rows[scene].iloc[0]], "png": [png(image[:, :, 0] if len(channels) == 1 else image)]})

    return px.select(scene, "r", "c", *channels).groupBy(scene).applyInPandas(run, f"{scene} {px.schema[scene].dataType.simpleString()}, png binary")


def data_uri(image: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(image))


def geojson(regions: DataFrame, transform: list[float], scene: str = "scene_id") -> DataFrame:
    """scene and geojson: a collection of the regions' boxes in the image's coordinates."""
    a, b, c, d, e, f = transform
    at = lambda x, y: F.array(F.col(x) * a + F.col(y) * b + c, F.col(x) * d + F.col(y) * e + f)
    ring = F.array(*[at(x, y) for x, y in (("c0", "r0"), ("c1", "r0"), ("c1", "r1"), ("c0", "r1"), ("c0", "r0"))])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(F.col("label").alias("id"), "pixel_area", "score").alias("properties"),
    )
    rows = regions.groupBy(scene).agg(F.sort_array(F.collect_list(F.struct("rank", feature.alias("feature")))).alias("x"))
    features = F.transform("x", lambda x: x["feature"])
    return rows.select(scene, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))).alias("geojson"))


def geojson_shapes(shapes: DataFrame, properties: list[str], scene: str = "scene_id") -> DataFrame:
    """scene and geojson: a collection of ``region_shapes`` (scene, label, geojson) with their properties."""
    given = F.to_json(F.struct(F.col("label").alias("id"), *properties))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geojson"), F.lit(',"properties":'), given, F.lit("}"))
    rows = shapes.groupBy(scene).agg(F.sort_array(F.collect_list(F.struct("label", feature.alias("f")))).alias("x"))
    listed = F.array_join(F.transform("x", lambda x: x["f"]), ",")
    return rows.select(scene, F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("geojson"))


def html_report(records: DataFrame, fields: list[str]) -> DataFrame:
    """``records`` with html: a table of its fields, escaped."""
    cells = [F.concat(F.lit(f"<tr><th>{n}</th><td>"), html_escape(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit("</td></tr>")) for n in fields]
    return records.withColumn("html", F.concat(F.lit("<!doctype html><table>"), *cells, F.lit("</table>")))


class RecordStore:
    """Records as a Parquet table: append, add under new identifiers, get, newest first."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.claims = allocation.Claims(spark, self.path + ".claims")

    def exists(self) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder))

    def add(self, records: DataFrame, created: str = "created_at", key: str = "request_id") -> DataFrame:
        """Store ``records`` under identifiers of their own years; gives them with their id.

        Several writers may do so at once. See ``allocation.with_ids`` for what is refused.
        """
        found = allocation.with_ids(records, created, key, self.claims, self.all() if self.exists() else None)
        kept = staged(found)
        self.append(kept)
        return kept

    def append(self, records: DataFrame) -> None:
        """Store ``records`` as they are, in a folder of their own: writers of one folder would clear each other's drafts."""
        records.write.parquet(f"{self.path}/batch={uuid.uuid4().hex}")

    def all(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path).drop("batch")

    def get(self, record_id: str) -> DataFrame:
        return self.all().where(F.col("id") == record_id)

    def newest(self, limit: int) -> DataFrame:
        if not 1 <= limit <= 200:
            raise ValueError("a limit is 1 to 200")
        return self.all().orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
