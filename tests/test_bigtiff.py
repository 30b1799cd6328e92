"""TIFF containers: what is written, byte by byte, what is read of it, and what an interrupted run leaves."""

import struct

import numpy as np
import pytest

from rastrel.sources import bigtiff as B
from rastrel.sources import tiff

LAYOUT = B.Layout(2, 150, 217, "uint16", 32, 3, ("DAPI", 'A "b"'), 0.65)
PLANES = np.random.default_rng(1).integers(0, 65536, (2, 150, 217)).astype(np.uint16)


def halved(plane):
    h, w = plane.shape
    wide = np.pad(plane.astype(float), ((0, h % 2), (0, w % 2)), constant_values=np.nan)
    return np.rint(np.nanmean(wide.reshape(wide.shape[0] // 2, 2, -1, 2), axis=(1, 3))).astype(plane.dtype)


def tile_rows(spark, planes, size, drop=()):
    rows = [(c, y, x, *planes[c, y : y + size, x : x + size].shape, str(planes.dtype), planes[c, y : y + size, x : x + size].tobytes()) for c in range(len(planes)) for y in range(0, planes.shape[1], size) for x in range(0, planes.shape[2], size) if (c, y, x) not in drop]
    return spark.createDataFrame(rows, "channel int, y0 long, x0 long, h int, w int, dtype string, px binary").repartition(5)


def planes_of(spark, path, level=0):
    tiles = B.read_tiles(spark, path).where(f"level = {level}").collect()
    out = np.zeros((max(r["channel"] for r in tiles) + 1, max(r["y0"] + r["h"] for r in tiles), max(r["x0"] + r["w"] for r in tiles)), tiles[0]["dtype"])
    for r in tiles:
        out[r["channel"], r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["px"], out.dtype).reshape(r["h"], r["w"])
    return out


def test_a_pyramid_is_read_back_and_agrees_with_the_other_parser(spark, tmp_path):
    path = str(tmp_path / "a.ome.tif")
    assert B.write_pyramid(tile_rows(spark, PLANES, 50), path, LAYOUT) == [0, 1, 2]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.ome.tif"]
    want = PLANES
    for level in range(3):
        assert (planes_of(spark, path, level) == want).all()
        want = np.stack([halved(p) for p in want])
    raw = (tmp_path / "a.ome.tif").read_bytes()
    pages = tiff.pages(raw)
    assert raw[:4] == b"II\x2b\x00" and len(pages) == 2 and [len(p[B.SUB_IFDS]) for p in pages] == [2, 2]
    for plane, page in zip(PLANES, pages):
        for y, x, block in tiff.tiles(raw, page):
            assert (plane[y : y + 32, x : x + 32] == block).all()
    source = B.Ranges(path)
    assert B.channel_names(source, B.directories(source)) == ["DAPI", 'A "b"']


def test_an_interrupted_run_is_taken_up_and_another_input_is_not(spark, tmp_path, monkeypatch):
    whole, path = str(tmp_path / "whole.tif"), str(tmp_path / "a.tif")
    B.write_pyramid(tile_rows(spark, PLANES, 50), whole, LAYOUT, "input 1")

    def broken(tiles, layout, level, halve, real=B.retiled):
        if level == 2:
            raise RuntimeError("lost")
        return real(tiles, layout, level, halve)

    monkeypatch.setattr(B, "retiled", broken)
    with pytest.raises(RuntimeError, match="lost"):
        B.write_pyramid(tile_rows(spark, PLANES, 50), path, LAYOUT, "input 1")
    monkeypatch.undo()
    assert not (tmp_path / "a.tif").exists() and B.Draft(path).done(LAYOUT.fingerprint("input 1")) == [0, 1]
    assert B.Draft(path).done(LAYOUT.fingerprint("input 2")) == []
    assert B.write_pyramid(tile_rows(spark, PLANES, 50), path, LAYOUT, "input 1") == [2]
    assert (tmp_path / "a.tif").read_bytes() == (tmp_path / "whole.tif").read_bytes()
    assert B.write_pyramid(tile_rows(spark, PLANES, 50), path, LAYOUT, "input 2") == [0, 1, 2]


def test_a_level_that_lacks_tiles_or_has_wrong_ones_is_not_whole(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    with pytest.raises(Exception, match="tiles"):
        B.write_pyramid(tile_rows(spark, PLANES, 32, drop={(1, 64, 96)}), path, LAYOUT)
    assert B.Draft(path).done(LAYOUT.fingerprint()) == [] and not (tmp_path / "a.tif").exists()
    writer = B.Writer({"path": path, "level": "0", "fingerprint": "", "layout": B.json.dumps(vars(LAYOUT))}, ["channel", "y0", "x0", "h", "w", "px"])
    for bad in ((2, 0, 0, 32, 32, 2048), (0, 16, 0, 32, 32, 2048), (0, 0, 0, 32, 31, 1984), (0, 128, 0, 32, 32, 2048)):
        with pytest.raises(ValueError, match="tile"):
            writer._check(*bad)
    with pytest.raises(ValueError, match="lack"):
        B.Writer({"path": path, "level": "0", "fingerprint": "", "layout": B.json.dumps(vars(LAYOUT))}, ["px"])


def test_filters_reach_the_source_and_bound_what_is_read(spark, tmp_path):
    path = str(tmp_path / "a.tif")
    B.write_pyramid(tile_rows(spark, PLANES, 50), path, LAYOUT)
    box = {(r["y"], r["x"]): r["v"] for r in B.read_box(spark, path, 1, (-3, 40, 200, 225)).collect()}
    assert len(box) == 43 * 25 and all(v == (PLANES[1, y, x] if 0 <= y < 150 and x < 217 else 0) for (y, x), v in box.items())
    with pytest.raises(IndexError):
        B.read_box(spark, path, 2, (0, 1, 0, 1))

    def read(*filters):
        reader = B.Reader({"path": path})
        assert list(reader.pushFilters(list(filters))) == []
        total = 0
        for part in reader.partitions():
            source = B.Ranges(path)
            list(B.read_run(part, lambda y0, x0: reader._wants(y0=y0, x0=x0), source))
            total += source.bytes_read
        return total

    every, one = read(), read(B.EqualTo(("channel",), 1), B.EqualTo(("level",), 0), B.LessThan(("y0",), 32), B.GreaterThanOrEqual(("x0",), 192))
    assert every > 2 * 150 * 217 * 2 and one <= 32 * 32 * 2 + 64
    plan = B.read_tiles(spark, path).where("channel = 1 and y0 < 32")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")


def interleaved(planes, rows):
    """A classic big-endian file with samples side by side, in strips."""
    c, height, width = planes.shape
    body = np.moveaxis(planes, 0, 2).astype(">u2")
    strips = [body[y : y + rows].tobytes() for y in range(0, height, rows)]
    out, places = bytearray(b"MM\0*\0\0\0\0"), []
    for s in strips:
        places.append(len(out))
        out += s
    tables = {}
    for tag, values in ((273, places), (279, [len(s) for s in strips])):
        tables[tag] = len(out)
        out += struct.pack(f">{len(values)}I", *values)
    short = lambda tag, v: struct.pack(">HHIHH", tag, 3, 1, v, 0)
    entries = [short(256, width), short(257, height), short(258, 16), short(259, 1), struct.pack(">HHII", 273, 4, len(strips), tables[273]), short(277, c), short(278, rows), struct.pack(">HHII", 279, 4, len(strips), tables[279]), short(284, 1)]
    out[4:8] = struct.pack(">I", len(out))
    return bytes(out) + struct.pack(">H", len(entries)) + b"".join(entries) + b"\0" * 4


def test_other_layouts(spark, tmp_path):
    planes = np.random.default_rng(2).integers(0, 65536, (3, 45, 70)).astype(np.uint16)
    (tmp_path / "rgb.tif").write_bytes(interleaved(planes, 7))
    assert (planes_of(spark, str(tmp_path / "rgb.tif")) == planes).all()
    only = B.read_tiles(spark, str(tmp_path / "rgb.tif")).where("channel = 2").collect()
    assert {r["channel"] for r in only} == {2} and sum(r["h"] for r in only) == 45
    real = np.random.default_rng(3).random((2, 33, 40)).astype(np.float32)
    (tmp_path / "real.tif").write_bytes(tiff.write(real, None, 16, True))
    got = planes_of(spark, str(tmp_path / "real.tif"))
    assert got.dtype == np.float32 and (got == real).all()
    pixels = B.to_pixels(B.read_tiles(spark, str(tmp_path / "real.tif"))).where("channel = 1 and y = 5 and x = 20").collect()
    assert pixels[0]["v"] is None and abs(pixels[0]["f"] - real[1, 5, 20]) < 1e-9
    assert len(B.files(str(tmp_path))) == 2
    with pytest.raises(ValueError, match="not a TIFF"):
        (tmp_path / "no.tif").write_bytes(b"GIF89a..........")
        B.directories(B.Ranges(str(tmp_path / "no.tif")))


def test_a_flat_file_becomes_a_pyramidal_one(spark, tmp_path):
    (tmp_path / "flat.tif").write_bytes(tiff.write(PLANES, ["x", "y"]))
    assert B.to_pyramid(spark, str(tmp_path / "flat.tif"), str(tmp_path / "out.tif"), 32, 40) == [0, 1, 2]
    assert (planes_of(spark, str(tmp_path / "out.tif")) == PLANES).all()
    assert planes_of(spark, str(tmp_path / "out.tif"), 2).shape == (2, 38, 55)
    (tmp_path / "mixed.tif").write_bytes(interleaved(PLANES, 150)[:-4] + b"\0" * 4)
    with pytest.raises(ValueError, match="multiple of 16"):
        B.Layout(1, 5, 5, "uint8", 20, 1)
