"""GeoTIFF scenes: header scan, pixel scan and a plain writer.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads will do; a task
parses one file at a time. Strips and tiles, plain, LZW or DEFLATE, with either predictor, are read; other
layouts get an error code.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.sources import blocks

#: TIFF field type -> struct code; sample format and bits -> numpy type (fixed values).
_FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
META_DDL = (
    "path string, width int, height int, band_count int, dtype string, crs_epsg int, transform array<double>, "
    "nodata double, band_descriptions array<string>, bounds array<double>, tags map<string,string>, error_code string"
)


def parse(data: bytes) -> dict:
    """Fields of a TIFF's first directory, by tag number."""
    if not data:
        raise ValueError("EMPTY_FILE")
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("INVALID_GEOTIFF")
    try:
        at = struct.unpack_from(order + "I", data, 4)[0]
        out: dict = {"order": order}
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            code = _FIELDS.get(kind)
            if code is None:
                continue
            size = struct.calcsize("<" + code) * n
            where = at + 2 + 12 * k + 8
            if size > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if code == "s":
                out[tag] = data[where : where + n].rstrip(b"\0").decode("utf-8", "replace")
            else:
                out[tag] = struct.unpack_from(order + code * n, data, where)
        out[256], out[257]
        return out
    except (struct.error, KeyError, IndexError) as broken:
        raise ValueError("INVALID_GEOTIFF") from broken


def metadata(path: str, data: bytes) -> dict:
    """One row of ``META_DDL``; a file that can't be read gives its error code and nulls."""
    row = dict.fromkeys(n.split()[0] for n in META_DDL.split(", "))
    row["path"] = path
    try:
        tags = parse(data)
    except ValueError as e:
        return row | {"error_code": str(e)}
    scale, tie, keys = tags.get(33550), tags.get(33922), tags.get(34735, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (3072, 2048)), None)
    transform = None
    if scale and tie:
        transform = [scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1]]
    a, _, c, _, e, f = transform or [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    right, bottom = c + a * tags[256][0], f + e * tags[257][0]
    items = re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', tags.get(42112, ""))
    bits, kind = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    nodata = tags.get(42113)
    described = tags.get(270)
    return row | {
        "width": tags[256][0], "height": tags[257][0], "band_count": tags.get(277, (1,))[0], "dtype": _SAMPLES.get((kind, bits)),
        "crs_epsg": epsg, "transform": transform or [1.0, 0.0, 0.0, 0.0, 1.0, 0.0],
        "nodata": float(nodata) if nodata else None, "band_descriptions": described.split("|") if described else [],
        "bounds": [min(c, right), min(f, bottom), max(c, right), max(f, bottom)], "tags": dict(items),
    }


def sample_kind(tags: dict) -> str:
    kind = _SAMPLES.get((tags.get(339, (1,))[0], tags.get(258, (8,))[0]))
    if kind is None:
        raise ValueError("UNSUPPORTED_LAYOUT")
    return kind


def bands(data: bytes, edge: int = 0, nearest: bool = False) -> np.ndarray:
    """(bands, height, width) as doubles, its longer edge cut to ``edge`` (0: whole); nodata is NaN."""
    tags = parse(data)
    return np.stack([grid for _, grid in blocks.decimated(data, tags, sample_kind(tags), edge, nearest)])


def encode(cube: np.ndarray, epsg: int | None = None, origin: tuple[float, float] = (0.0, 0.0), pixel: float = 1.0, nodata: float | None = None, descriptions: list[str] | None = None) -> bytes:
    """A band-sequential GeoTIFF of one strip a band, without compression."""
    n, h, w = cube.shape
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    body = cube.astype(cube.dtype.newbyteorder("<")).tobytes()
    plane = len(body) // n
    fields: list[tuple[int, int, int, bytes]] = [
        (256, 4, 1, struct.pack("<I", w)), (257, 4, 1, struct.pack("<I", h)), (258, 3, n, struct.pack(f"<{n}H", *[cube.itemsize * 8] * n)), (259, 3, 1, struct.pack("<H", 1)),
        (262, 3, 1, struct.pack("<H", 1)), (273, 4, n, struct.pack(f"<{n}I", *[8 + plane * k for k in range(n)])), (277, 3, 1, struct.pack("<H", n)), (278, 4, 1, struct.pack("<I", h)),
        (279, 4, n, struct.pack(f"<{n}I", *[plane] * n)), (284, 3, 1, struct.pack("<H", 2)), (339, 3, n, struct.pack(f"<{n}H", *[kind] * n)),
    ]
    if descriptions:
        text = "|".join(descriptions).encode() + b"\0"
        fields.append((270, 2, len(text), text))
    if epsg:
        fields.append((33550, 12, 3, struct.pack("<3d", pixel, pixel, 0.0)))
        fields.append((33922, 12, 6, struct.pack("<6d", 0, 0, 0, *origin, 0)))
        fields.append((34735, 3, 8, struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, epsg)))
    if nodata is not None:
        text = str(nodata).encode() + b"\0"
        fields.append((42113, 2, len(text), text))
    fields.sort()
    at = 8 + len(body)
    extra, entries = b"", b""
    for tag, code, count, value in fields:
        if len(value) > 4:
            entries += struct.pack("<HHII", tag, code, count, at + 2 + 12 * len(fields) + 4 + len(extra))
            extra += value
        else:
            entries += struct.pack("<HHI", tag, code, count) + value.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its header, or an error code. Spark lists no file without a byte."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = pd.DataFrame([metadata(p, c) for p, c in zip(part["path"], part["content"])])
            yield rows.astype({"width": "Int32", "height": "Int32", "band_count": "Int32", "crs_epsg": "Int32", "nodata": "Float64"})

    return _files(spark, path).select("path", "content").mapInPandas(run, META_DDL)


def scan_pixels(spark: SparkSession, path: str, max_edge: int = 1024, nearest: bool = False) -> DataFrame:
    """path, band, r, c, value, error_code of every file, its longer edge cut to ``max_edge`` (0: whole).

    A wanted pixel is the mean of the valid ones that lie in it, by how much of each does, or with
    ``nearest``, for classes and masks, the one in its middle; invalid pixels are null. The shape is that of
    ``geometry.decimated``. A file that can't be read gives one row with its error and nulls.
    """
    names = ["path", "band", "r", "c", "value", "error_code"]

    def frame(path: str, band: int, grid: np.ndarray) -> pd.DataFrame:
        place, width = np.arange(grid.size), grid.shape[1]
        value = pd.array(grid.reshape(-1), dtype="Float64")
        return pd.DataFrame({"path": path, "band": band, "r": place // width, "c": place % width, "value": value, "error_code": None})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"]):
                try:
                    tags = parse(content)
                    for band, grid in blocks.decimated(content, tags, sample_kind(tags), max_edge, nearest):
                        yield frame(p, band, grid)
                except ValueError as broken:
                    failed = pd.DataFrame([[p, None, None, None, None, str(broken)]], columns=names)
                    yield failed.astype({"band": "Int32", "r": "Int32", "c": "Int32", "value": "Float64"})

    rows = _files(spark, path).select("path", "content").mapInPandas(run, "path string, band int, r int, c int, value double, error_code string")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


#: Keywords in a band's description, in the order they are tried (fixed values).
ROLE_KEYWORDS = (
    ("swir2", ("swir2", "b12", "swir 2")),
    ("swir1", ("swir1", "b11", "swir 1", "swir")),
    ("nir", ("nir", "b08", "b8", "near infrared", "near-infrared")),
    ("red", ("red", "b04", "b4")),
    ("green", ("green", "b03", "b3")),
    ("blue", ("blue", "b02", "b2")),
    ("vv", ("vv",)),
    ("vh", ("vh",)),
    ("gray", ("gray", "grey", "amplitude", "intensity", "backscatter", "sigma0")),
    ("alpha", ("alpha", "mask")),
)
#: Roles by number of bands, where descriptions don't tell (fixed values).
CONVENTIONS = {
    1: ("gray",),
    2: ("gray", "alpha"),
    3: ("red", "green", "blue"),
    4: ("red", "green", "blue", "nir"),
    6: ("blue", "green", "red", "nir", "swir1", "swir2"),
    12: ("unknown", "blue", "green", "red", "unknown", "unknown", "unknown", "nir", "unknown", "unknown", "swir1", "swir2"),
    13: ("unknown", "blue", "green", "red", "unknown", "unknown", "unknown", "nir", "unknown", "unknown", "unknown", "swir1", "swir2"),
}
#: The same for radar, and for picture files without a place on earth (fixed values).
RADAR_CONVENTIONS = {1: ("gray",), 2: ("vv", "vh")}
PICTURE_CONVENTIONS = {4: ("red", "green", "blue", "alpha")}
PICTURES = ("PNG", "JPEG", "GIF", "BMP")
#: Words in a path or a tag that name the sensor; radar's are tried first (fixed values).
RADAR_WORDS = ("sar", "sentinel-1", "sentinel1", "s1a", "s1b", "grd", "slc", "backscatter", "sigma0", "radar", "alos", "palsar", "risat", "eos-04")
OPTICAL_WORDS = ("optical", "sentinel-2", "sentinel2", "landsat", "msi", "rgb", "multispectral", "resourcesat", "liss")


def band_roles(meta: DataFrame) -> DataFrame:
    """``meta`` with band_roles: from descriptions if half of them are known, else by convention.

    The convention goes by the number of bands, and by driver and modality where ``meta`` has these
    columns. Other numbers give unknown roles; a null count gives null.
    """

    def role(described: Column) -> Column:
        text = F.lower(F.trim(described))
        return F.coalesce(*[F.when(text.rlike("|".join(words)), name) for name, words in ROLE_KEYWORDS], F.lit("unknown"))

    def usual(table: dict[int, tuple[str, ...]], other: Column) -> Column:
        return F.coalesce(*[F.when(F.col("band_count") == n, F.array(*map(F.lit, names))) for n, names in table.items()], other)

    unknown = F.array_repeat(F.lit("unknown"), F.col("band_count"))
    roles = usual(CONVENTIONS, unknown)
    if "driver" in meta.columns:
        roles = F.when(F.upper("driver").isin(*PICTURES), usual(PICTURE_CONVENTIONS, roles)).otherwise(roles)
    if "modality" in meta.columns:
        roles = F.when(F.col("modality") == "sar", usual(RADAR_CONVENTIONS, unknown)).otherwise(roles)
    described = F.transform("band_descriptions", role)
    known = F.size(F.filter(described, lambda x: x != "unknown"))
    enough = (F.size(described) > 0) & (F.size(described) == F.col("band_count")) & (known >= F.greatest(F.lit(1), F.floor(F.size(described) / 2)))
    return meta.withColumn("band_roles", F.when(F.coalesce(enough, F.lit(False)), described).otherwise(roles))


def modality(path: Column, tags: Column, roles: Column) -> Column:
    """``sar``, ``optical`` or ``unknown``: by the file's name and its tags, else by its roles.

    ``tags`` is a map of strings; null counts as empty.
    """
    written = F.transform(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    text = F.lower(F.concat_ws(" ", F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1), F.array_join(written, " ")))
    named = lambda words: F.greatest(*[F.contains(text, F.lit(w)) for w in words])
    holds = lambda *names: F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, names))), F.lit(False))
    out = F.when(named(RADAR_WORDS), "sar").when(named(OPTICAL_WORDS), "optical").when(holds("vv", "vh"), "sar")
    return out.when(holds("red", "green", "blue", "nir"), "optical").otherwise("unknown")
