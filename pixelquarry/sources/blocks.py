"""The blocks of a TIFF, tiles or strips: where they lie, how they are packed, and decimation block by block.

Only one block is unpacked at a time, so what a file takes is its own bytes, the wanted grid and a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Compression codes: none, LZW, two of DEFLATE; predictors: none, difference, floating point (fixed values).
PLAIN, LZW, DEFLATE = (1,), (5,), (8, 32946)
#: LZW's clearing and ending codes, its first free one and its longest code in bits (fixed values).
CLEAR, END, FREE, WIDEST = 256, 257, 258, 12


@dataclass(frozen=True)
class Block:
    """A window of the picture (its first row and column, its size as stored) of one band or, without one, of all."""

    offset: int
    length: int
    row: int
    column: int
    height: int
    width: int
    band: int | None


def unlzw(data: bytes) -> bytes:
    """Codes of nine bits and more, most significant bit first; a code's width grows one entry early."""
    out, table = bytearray(), [bytes([k]) for k in range(256)] + [b"", b""]
    bits, held, width, before = 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            del table[FREE:]
            width, before = 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("INVALID_GEOTIFF")
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
            width = min(WIDEST, max(9, (len(table) + 1).bit_length()))
        before = entry
    return bytes(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression in PLAIN:
        return data
    try:
        return unlzw(data) if compression in LZW else zlib.decompress(data)
    except zlib.error as broken:
        raise ValueError("INVALID_GEOTIFF") from broken


def layout(tags: dict) -> list[Block]:
    """The directory of a TIFF's blocks, in the file's order."""
    w, h, n = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    tiled = 324 in tags
    offsets, lengths = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not offsets or not lengths or tags.get(259, (1,))[0] not in (*PLAIN, *LZW, *DEFLATE) or tags.get(317, (1,))[0] not in (1, 2, 3):
        raise ValueError("UNSUPPORTED_LAYOUT")
    width, height = (tags[322][0], tags[323][0]) if tiled else (w, min(h, tags.get(278, (h,))[0]))
    across, down = -(-w // width), -(-h // height)
    planar = tags.get(284, (1,))[0] == 2
    if len(offsets) < across * down * (n if planar else 1):
        raise ValueError("INVALID_GEOTIFF")
    out = []
    for k, (offset, length) in enumerate(zip(offsets, lengths)):
        band, place = divmod(k, across * down)
        row, column = divmod(place, across)
        # Tiles are stored whole, the last strip as far as the picture goes.
        tall = height if tiled else min(height, h - row * height)
        out.append(Block(offset, length, row * height, column * width, tall, width, band if planar else None))
    return out


def unblocked(data: bytes, block: Block, tags: dict, kind: str) -> np.ndarray:
    """(bands, rows, columns) of a block as it is stored, so a tile at the edge reaches beyond the picture."""
    samples = 1 if block.band is not None else tags.get(277, (1,))[0]
    dtype, predictor = np.dtype(tags["order"] + kind), tags.get(317, (1,))[0]
    raw = unpacked(data[block.offset : block.offset + block.length], tags.get(259, (1,))[0])
    row = block.width * samples
    size = block.height * row * dtype.itemsize
    if len(raw) < size:
        raise ValueError("INVALID_GEOTIFF")
    if predictor == 3:
        # Bytes of a row stand by significance, the highest first, as differences.
        summed = np.frombuffer(raw[:size], np.uint8).reshape(block.height, -1, samples).cumsum(axis=1, dtype=np.uint8)
        planes = summed.reshape(block.height, dtype.itemsize, row)
        flat = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(">" + kind))
    else:
        flat = np.frombuffer(raw[:size], dtype)
        if predictor == 2:
            own = flat.astype(dtype.newbyteorder("=")).view(f"u{dtype.itemsize}")
            flat = own.reshape(block.height, block.width, samples).cumsum(axis=1, dtype=own.dtype).view(dtype.newbyteorder("="))
    return flat.reshape(block.height, block.width, samples).transpose(2, 0, 1).astype(np.float64)


def wanted_shape(width: int, height: int, edge: int) -> tuple[int, int]:
    """Columns and rows after decimation to ``edge`` (0: none); half rounds to even, as ``geometry.decimated``."""
    longest = max(width, height)
    factor = longest / edge if 0 < edge < longest else 1.0
    return max(1, round(width / factor)), max(1, round(height / factor))


def _shares(size: int, wanted: int, start: int, stop: int) -> np.ndarray:
    """What each source row from ``start`` to ``stop`` lies in each wanted row, as a share of a source row."""
    ends = np.arange(wanted + 1) * (size / wanted)
    low, high = ends[:-1, None], ends[1:, None]
    own = np.arange(start, stop)[None, :]
    return np.clip(np.minimum(high, own + 1) - np.maximum(low, own), 0.0, 1.0)


def nearest_of(size: int, wanted: int) -> np.ndarray:
    """The source row whose middle is nearest below each wanted row's."""
    return np.minimum(((np.arange(wanted) + 0.5) * size / wanted).astype(np.int64), size - 1)


def decimated(data: bytes, tags: dict, kind: str, edge: int, nearest: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """band (from 1) and its wanted grid; invalid pixels are NaN.

    Means weigh valid pixels by how much of each lies in a wanted one; the nearest path takes single pixels
    and leaves blocks alone in which none lies.
    """
    w, h, n = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    columns, rows = wanted_shape(w, h, edge)
    nodata = float(tags[42113]) if tags.get(42113) else None
    total, weight = np.zeros((n, rows, columns)), np.zeros((n, rows, columns))
    at_r, at_c = nearest_of(h, rows), nearest_of(w, columns)
    for block in layout(tags):
        bottom, right = min(h, block.row + block.height), min(w, block.column + block.width)
        bands = range(n) if block.band is None else (block.band,)
        if nearest or (rows, columns) == (h, w):
            r, c = (np.flatnonzero((at >= a) & (at < b)) for at, a, b in ((at_r, block.row, bottom), (at_c, block.column, right)))
            if not len(r) or not len(c):
                continue
            found = unblocked(data, block, tags, kind)
            for k, band in enumerate(bands):
                taken = found[k][np.ix_(at_r[r] - block.row, at_c[c] - block.column)]
                valid = np.isfinite(taken) if nodata is None else np.isfinite(taken) & (taken != nodata)
                total[band][np.ix_(r, c)] = np.where(valid, taken, 0.0)
                weight[band][np.ix_(r, c)] = valid
            continue
        found = unblocked(data, block, tags, kind)[:, : bottom - block.row, : right - block.column]
        down, across = _shares(h, rows, block.row, bottom), _shares(w, columns, block.column, right)
        r, c = (np.flatnonzero(s.any(axis=1)) for s in (down, across))
        for k, band in enumerate(bands):
            valid = np.isfinite(found[k]) if nodata is None else np.isfinite(found[k]) & (found[k] != nodata)
            total[band][np.ix_(r, c)] += down[r] @ np.where(valid, found[k], 0.0) @ across[c].T
            weight[band][np.ix_(r, c)] += down[r] @ valid.astype(np.float64) @ across[c].T
    for band in range(n):
        yield band + 1, np.where(weight[band] > 1e-12, total[band] / np.maximum(weight[band], 1e-12), np.nan)
