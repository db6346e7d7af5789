"""PNG pictures as scenes: 8-bit gray, gray with alpha, colour and colour with alpha, not interlaced."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Colour type -> channels (fixed values).
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of bytes; other kinds of file raise ValueError with an error code."""
    if not data:
        raise ValueError("EMPTY_FILE")
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("INVALID_FILE")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    if head is None or not body:
        raise ValueError("INVALID_FILE")
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in _CHANNELS or interlaced:
        raise ValueError("UNSUPPORTED_LAYOUT")
    n = _CHANNELS[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    except (zlib.error, ValueError) as broken:
        raise ValueError("INVALID_FILE") from broken
    out = np.zeros((h + 1, w + 1, n), dtype=np.int64)  # a row and a column of zeros before the picture
    for r in range(h):
        how, line = int(raw[r, 0]), raw[r, 1:].reshape(w, n).astype(np.int64)
        above, row = out[r], out[r + 1]
        if how == 0:
            row[1:] = line
        elif how == 1:
            row[1:] = np.cumsum(line, axis=0) & 255
        elif how == 2:
            row[1:] = (line + above[1:]) & 255
        elif how in (3, 4):
            for c in range(1, w + 1):
                left, up, corner = row[c - 1], above[c], above[c - 1]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    off = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.choose(off.argmin(axis=0), [left, up, corner])
                row[c] = (line[c - 1] + guess) & 255
        else:
            raise ValueError("INVALID_FILE")
    return out[1:, 1:].astype(np.uint8)


def scan_png(spark: SparkSession, path: str) -> DataFrame:
    """path, error_code, r, c and values (array, a channel each) of every pixel of the PNG files under
    ``path``; a file that can't be read is one row with its error code and nulls."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"]):
                try:
                    image = decode(content)
                except ValueError as e:
                    yield pd.DataFrame({"path": [p], "error_code": [str(e)], "r": pd.array([None], "Int32"), "c": pd.array([None], "Int32"), "values": [None]})
                    continue
                h, w, _ = image.shape
                for r in range(h):
                    yield pd.DataFrame({"path": p, "error_code": None, "r": np.int32(r), "c": np.arange(w, dtype=np.int32), "values": list(image[r].astype(np.int32))})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, error_code string, r int, c int, values array<int>")
