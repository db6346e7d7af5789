"""Every layout of a TIFF's blocks, decimation to the exact shape, and files that can't be read."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.operators import geometry
from pixelquarry.sources import blocks, geotiff


def lzw(data: bytes) -> bytes:
    """A plain encoder: longest known sequence, the table cleared when it is full."""
    bits, table, width, word = "", {bytes([k]): k for k in range(256)}, 9, b""
    size, out = 258, [(256, 9)]
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        out.append((table[word], width))
        table[longer] = size
        size += 1
        width = max(9, size.bit_length())
        if size >= 4094:
            out.append((256, 12))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([byte])
    if word:
        out.append((table[word], width))
        width = max(9, (size + 1).bit_length())
    out.append((257, width))
    bits = "".join(format(code, f"0{n}b") for code, n in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def written(cube, tile=None, strip=None, compression=1, predictor=1, planar=True, nodata=None, meta=None):
    """A TIFF of the layout that is asked for."""
    n, h, w = cube.shape
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    tall, wide = tile or (strip or h, w)
    parts = []
    for group in [cube[k : k + 1] for k in range(n)] if planar else [cube]:
        for r in range(0, h, tall):
            for c in range(0, w, wide):
                part = group[:, r : r + tall, c : c + wide]
                if tile:
                    part = np.pad(part, ((0, 0), (0, tall - part.shape[1]), (0, wide - part.shape[2])))
                rows = np.ascontiguousarray(part.transpose(1, 2, 0))
                if predictor == 2:
                    whole = rows.view(f"u{rows.itemsize}")
                    rows = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], axis=1)
                if predictor == 3:
                    planes = rows.reshape(rows.shape[0], -1).astype(rows.dtype.newbyteorder(">")).view(np.uint8).reshape(rows.shape[0], -1, rows.itemsize).transpose(0, 2, 1)
                    flat = planes.reshape(rows.shape[0], -1, rows.shape[2])
                    rows = np.concatenate([flat[:, :1], np.diff(flat, axis=1)], axis=1)
                raw = rows.tobytes()
                parts.append({1: lambda x: x, 5: lzw, 8: zlib.compress}[compression](raw))
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    longs = lambda xs: (4, len(xs), struct.pack(f"<{len(xs)}I", *xs))
    shorts = lambda xs: (3, len(xs), struct.pack(f"<{len(xs)}H", *xs))
    text = lambda x: (2, len(x) + 1, x.encode() + b"\0")
    fields = {256: longs([w]), 257: longs([h]), 258: shorts([cube.itemsize * 8] * n), 259: shorts([compression]), 277: shorts([n]), 284: shorts([2 if planar else 1]), 317: shorts([predictor]), 339: shorts([kind] * n)}
    fields |= {322: longs([wide]), 323: longs([tall]), 324: longs(offsets), 325: longs([len(p) for p in parts])} if tile else {273: longs(offsets), 278: longs([tall]), 279: longs([len(p) for p in parts])}
    fields |= {42113: text(str(nodata))} if nodata is not None else {}
    fields |= {42112: text(meta)} if meta else {}
    extra, entries = b"", b""
    for tag in sorted(fields):
        code, count, value = fields[tag]
        if len(value) > 4:
            entries += struct.pack("<HHII", tag, code, count, at + 2 + 12 * len(fields) + 4 + len(extra))
            extra += value
        else:
            entries += struct.pack("<HHI", tag, code, count) + value.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(parts) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


@pytest.mark.parametrize("tile,strip", [(None, None), (None, 7), ((16, 16), None), ((32, 16), None)])
@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize("planar", [True, False])
@pytest.mark.parametrize("kind,predictor", [("u2", 1), ("u2", 2), ("i2", 2), ("u1", 2), ("f4", 3), ("f8", 3), ("f4", 1)])
def test_every_layout_comes_back(tile, strip, compression, planar, kind, predictor):
    rng = np.random.default_rng(3)
    cube = (rng.normal(0, 50, (3, 41, 53)).cumsum(axis=2) + 9000).astype(kind)
    got = geotiff.bands(written(cube, tile, strip, compression, predictor, planar))
    assert (got == cube).all()


def test_lzw_of_long_and_repeated_data():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"a" * 9000, rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), bytes(range(256)) * 60):
        assert blocks.unlzw(lzw(data)) == data


@pytest.mark.parametrize("shape,edge", [((150, 90), 100), ((1500, 700), 1024), ((64, 64), 64), ((7, 300), 20)])
def test_decimation_has_the_exact_shape_and_mean(spark, shape, edge):
    cube = np.random.default_rng(2).random((1, *shape)).astype("f4")
    cube[0, :3, :3] = -1
    data = written(cube, (64, 64), compression=8, nodata=-1)
    got = geotiff.bands(data, edge)[0]
    factor, w, h = spark.range(1).select(*[c.alias(n) for n, c in zip("fwh", geometry.decimated(F.lit(shape[1]), F.lit(shape[0]), edge))]).first()
    assert got.shape == (h, w)
    source = np.where(cube[0] == -1, np.nan, cube[0]).astype(float)
    for r, c in [(0, 0), (h // 2, w // 3), (h - 1, w - 1)]:
        r0, r1, c0, c1 = r * shape[0] / h, (r + 1) * shape[0] / h, c * shape[1] / w, (c + 1) * shape[1] / w
        total = weight = 0.0
        for i in range(int(r0), min(shape[0], int(np.ceil(r1 - 1e-9)))):
            for j in range(int(c0), min(shape[1], int(np.ceil(c1 - 1e-9)))):
                if not np.isnan(source[i, j]):
                    own = (min(r1, i + 1) - max(r0, i)) * (min(c1, j + 1) - max(c0, j))
                    total, weight = total + own * source[i, j], weight + own
        assert (np.isnan(got[r, c]) and weight < 1e-9) or got[r, c] == pytest.approx(total / weight, rel=1e-6)
    near = geotiff.bands(data, edge, nearest=True)[0]
    assert near.shape == (h, w) and set(near[~np.isnan(near)].tolist()) <= set(source.ravel().tolist())


def test_nearest_path_leaves_blocks_alone(monkeypatch):
    data = written(np.arange(128 * 128, dtype="u2").reshape(1, 128, 128), (16, 16), compression=8)
    opened, whole = [], blocks.unblocked
    monkeypatch.setattr(blocks, "unblocked", lambda d, block, *rest: opened.append(block) or whole(d, block, *rest))
    assert geotiff.bands(data, 4, nearest=True).shape == (1, 4, 4) and len(opened) == 16
    opened.clear()
    geotiff.bands(data, 4)
    assert len(opened) == 64


def test_files_of_all_kinds_give_rows(spark, tmp_path):
    cube = np.arange(2 * 20 * 30, dtype=np.uint16).reshape(2, 20, 30)
    (tmp_path / "tiled.tif").write_bytes(written(cube, (16, 16), compression=5, predictor=2, meta='<GDALMetadata><Item name="SENSOR">MSI</Item></GDALMetadata>'))
    (tmp_path / "jpeg.tif").write_bytes(written(cube).replace(struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 1), struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 7)))
    (tmp_path / "cut.tif").write_bytes(written(cube, (16, 16), compression=8)[:60])
    rows = geotiff.scan_pixels(spark, str(tmp_path), 0).collect()
    by = {name: [r for r in rows if r.path.endswith(name)] for name in ("tiled.tif", "jpeg.tif", "cut.tif")}
    assert len(by["tiled.tif"]) == cube.size and all(r.value == cube[r.band - 1, r.r, r.c] and r.error_code is None for r in by["tiled.tif"])
    assert [(r.error_code, r.value) for r in by["jpeg.tif"]] == [("UNSUPPORTED_LAYOUT", None)] and [r.error_code for r in by["cut.tif"]] == ["INVALID_GEOTIFF"]
    meta = {r.path.rsplit("/", 1)[1]: r for r in geotiff.scan_metadata(spark, str(tmp_path)).collect()}
    assert meta["tiled.tif"].tags == {"SENSOR": "MSI"} and meta["tiled.tif"].bounds == [0.0, 0.0, 30.0, 20.0] and meta["cut.tif"].error_code == "INVALID_GEOTIFF"
