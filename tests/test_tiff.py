"""TIFF files written here are read back exactly, in every layout."""

import numpy as np
import pytest

from rastrel.sources import tiff


@pytest.mark.parametrize(("tile", "compress", "kind"), [(0, False, np.uint16), (16, False, np.uint8), (32, True, np.uint16), (0, True, np.float32)])
def test_round_trip(tile, compress, kind):
    planes = (np.random.default_rng(tile).random((2, 45, 70)) * 250).astype(kind)
    raw = tiff.write(planes, ["DAPI", 'Marker "A"'], tile, compress)
    for plane, page in zip(planes, tiff.pages(raw)):
        out = np.zeros_like(plane)
        for y, x, block in tiff.tiles(raw, page):
            out[y : y + block.shape[0], x : x + block.shape[1]] = block
        assert (out == plane).all()


def test_tables(spark, tmp_path):
    planes = np.arange(2 * 40 * 50, dtype=np.uint16).reshape(2, 40, 50)
    (tmp_path / "a.ome.tif").write_bytes(tiff.write(planes, ["DAPI", " "], 16))
    (tmp_path / "b.tiff").write_bytes(tiff.write(planes[:1]))
    heads = {(r["path"][-5:], r["page"]): (r["height"], r["width"], r["dtype"], r["is_tiled"]) for r in tiff.inspect(spark, str(tmp_path)).collect()}
    assert heads == {("e.tif", 0): (40, 50, "uint16", True), ("e.tif", 1): (40, 50, "uint16", True), (".tiff", 0): (40, 50, "uint16", False)}
    names = sorted((r["path"][-5:], r["channel_idx"], r["name"]) for r in tiff.channel_names(spark, str(tmp_path)).collect())
    assert names == [(".tiff", 0, "Channel 0"), ("e.tif", 0, "DAPI"), ("e.tif", 1, "Channel 1")]
    pixels = tiff.to_pixels(tiff.read_tiles(spark, str(tmp_path))).where("path like '%ome.tif'")
    got = np.zeros_like(planes)
    for r in pixels.collect():
        got[r["channel_idx"], r["y"], r["x"]] = r["v"]
    assert (got == planes).all()
    again = tiff.to_pixels(tiff.to_tiles(pixels, 16, ["channel_idx"]))
    assert again.exceptAll(pixels.select("channel_idx", "y", "x", "v")).count() == 0 and again.count() == pixels.count()
    tiff.save_tiles(tiff.to_tiles(pixels, 16, ["channel_idx"]), str(tmp_path / "out"), ["channel_idx"])
    assert spark.read.parquet(str(tmp_path / "out")).where("channel_idx = 1").count() == 12


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.pages(b"GIF89a..........")
