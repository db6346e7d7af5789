"""Uploads as a stream: every new file becomes a row of metadata, once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pixelquarry.sources.geotiff import META_DDL, metadata

MAX_BYTES = 200 * 1024 * 1024
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """A streaming table of headers; files over the size limit are read by name alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [metadata(p, c) if n <= MAX_BYTES else {**metadata(p, b""), "error_code": "FILE_TOO_LARGE"} for p, n, c in zip(part["path"], part["length"], part["content"])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in META_DDL.split(", ")]).astype(
                {"width": "Int32", "height": "Int32", "band_count": "Int32", "crs_epsg": "Int32", "nodata": "Float64"}
            )

    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).load(folder)
    return files.mapInPandas(run, META_DDL)
