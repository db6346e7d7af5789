"""The image store: allow-list, previews, one row a content, and batches that are run again."""

import numpy as np
import pytest

from pixelquarry.sources import geotiff
from pixelquarry.sources.sinks import png
from pixelquarry.streaming.image_store import PREVIEW, ImageStore, judged, read_uploads

TIFF = geotiff.encode(np.arange(3 * 100 * 200, dtype=np.uint16).reshape(3, 100, 200))


def test_what_is_let_in():
    code = lambda name, content: judged(name, len(content), content)["error_code"]
    assert code("a.tif", TIFF) is None and code("a.TIFF", TIFF) is None and code("a.png", png(np.zeros((3, 5), np.uint8))) is None
    assert code("a.exe", TIFF) == "UNSUPPORTED_TYPE" and code("noending", TIFF) == "UNSUPPORTED_TYPE" and code("a.png", TIFF) == "CONTENT_MISMATCH"
    assert code("a.tif", b"") == "EMPTY_FILE" and code("a.tif", TIFF[:30]) == "INVALID_GEOTIFF" and judged("a.tif", 10**9, TIFF)["error_code"] == "FILE_TOO_LARGE"
    row = judged("a.tif", len(TIFF), TIFF)
    assert (row["width"], row["height"], row["band_count"]) == (200, 100, 3)
    assert [int.from_bytes(row["preview"][k : k + 4], "big") for k in (16, 20)] == [PREVIEW, PREVIEW // 2]
    gray = judged("g.png", 60, png(np.zeros((3, 5), np.uint8)))
    assert (gray["width"], gray["height"], gray["band_count"]) == (5, 3, 1)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    store = ImageStore(spark, str(tmp_path / "store"))
    assert store.all().count() == 0
    batch = lambda *files: spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files], "path string, length long, content binary")
    other = geotiff.encode(np.ones((1, 4, 4), np.uint8))
    one = read_uploads(batch(("x/b.tif", TIFF), ("x/a.tif", TIFF), ("x/c.exe", TIFF)))
    two = read_uploads(batch(("x/d.tif", TIFF), ("x/e.tif", other)))
    for number, rows in ((0, one), (1, two), (1, two), (0, one), (1, two)):
        store.merge(rows, number)
    got = sorted((r.path, r.batch) for r in store.all().collect())
    assert got == [("x/a.tif", 0), ("x/e.tif", 1)]


def test_stream_is_followed_once_across_restarts(spark, tmp_path):
    folder, store = tmp_path / "in", ImageStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    run = lambda: store.follow(str(folder), str(tmp_path / "cp"), str(tmp_path / "refused")).awaitTermination(120)
    (folder / "a.tif").write_bytes(TIFF)
    (folder / "bad.txt").write_bytes(b"words")
    assert run()
    (folder / "again.tif").write_bytes(TIFF)
    (folder / "new.tif").write_bytes(geotiff.encode(np.ones((1, 9, 9), np.uint8)))
    assert run() and run()
    rows = store.all().collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.width) for r in rows) == [("a.tif", 200), ("new.tif", 9)]
    assert all(r.preview for r in rows)
    assert [r.error_code for r in spark.read.parquet(str(tmp_path / "refused")).collect()] == ["UNSUPPORTED_TYPE"]


@pytest.mark.parametrize("content", [b"II*\0", b"MM\0*" + bytes(4)])
def test_broken_headers_are_rows(content):
    assert judged("a.tif", len(content), content)["error_code"] == "INVALID_GEOTIFF"
