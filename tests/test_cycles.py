"""Cycles merged into one file: shifts, resuming in three modes, touch-up, commits."""

import json

import numpy as np
import pyarrow as pa
import pytest

from rastrel.operators import elastic as E
from rastrel.operators import merging as M
from rastrel.sources import bigtiff as B
from rastrel.sources import cycles as C

HOW = C.Settings(size=64, coarse=1, tile=32, levels=2)


def _plane(seed, h=96, w=128):
    y, x = np.mgrid[0:h, 0:w]
    r = np.random.default_rng(seed)
    return (8000 + 3000 * np.sin(y / 5.3 + seed) * np.cos(x / 4.7) + r.integers(0, 9000, (h, w))).astype("uint16")


def _back(plane, dy, dx):
    """What ``out[y, x] = in[y - dy, x - dx]`` turns into ``plane``, where that lies inside."""
    out = np.zeros_like(plane)
    h, w = plane.shape
    for y in range(h):
        for x in range(w):
            if 0 <= y + dy < h and 0 <= x + dx < w:
                out[y, x] = plane[y + dy, x + dx]
    return out


def _cycle(spark, number, planes, names, tile=32, version="1"):
    rows = []
    for c, p in enumerate(planes):
        for y in range(0, p.shape[0], tile):
            for x in range(0, p.shape[1], tile):
                block = p[y : y + tile, x : x + tile]
                rows.append({"channel": c, "y0": y, "x0": x, "h": block.shape[0], "w": block.shape[1], "dtype": str(p.dtype), "px": block.tobytes()})
    tiles = spark.createDataFrame(pa.Table.from_pylist(rows, E._schema(M.MOVED)).to_pandas(), M.MOVED)
    return C.Cycle(number, tiles, names, *planes[0].shape, str(planes[0].dtype), version)


def _read(spark, path, channel, shape):
    out = np.zeros(shape)
    for r in B.read_tiles(spark, path).where(f"level = 0 and channel = {channel}").collect():
        out[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["px"], r["dtype"]).reshape(r["h"], r["w"])
    return out


@pytest.fixture(scope="module")
def slide(spark):
    base, shifts = _plane(1), {1: (0, 0), 2: (3, -2), 4: (-5, 7), 9: (0, 4)}
    own = {n: _plane(n + 10) for n in shifts}
    return base, own, shifts, [_cycle(spark, n, [_back(base, *d), _back(own[n], *d)], ("DAPI", "CD8")) for n, d in shifts.items()]


def test_all_cycles_come_onto_the_reference(spark, slide, tmp_path):
    base, own, shifts, cycles = slide
    path = str(tmp_path / "m.ome.tif")
    rows = C.merge(spark, cycles, path, HOW)
    assert [(r["cycle"], r["action"], r["dy"], r["dx"]) for r in rows[:-1]] == [(n, "built", *map(float, d)) for n, d in shifts.items()]
    source = B.Ranges(path)
    assert B.channel_names(source, B.directories(source)) == [f"{m}_cy{n}" for n in shifts for m in ("DAPI", "CD8")]
    source.close()
    for k, (n, (dy, dx)) in enumerate(shifts.items()):
        want = np.zeros(base.shape)
        h, w = base.shape
        inside = np.s_[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
        want[inside] = own[n][inside]
        assert np.array_equal(_read(spark, path, 2 * k + 1, base.shape), want)
    assert not (tmp_path / "m.ome.tif.cycles").exists()
    assert [r["action"] for r in C.merge(spark, cycles, path, HOW)] == ["kept"] * 5


def test_a_run_that_stops_after_two_of_four_writes_only_the_rest(spark, slide, tmp_path):
    base, _, _, cycles = slide
    path, stage = str(tmp_path / "m.ome.tif"), tmp_path / "m.ome.tif.cycles"
    asked = []
    with pytest.raises(C.Cancelled):
        C.merge(spark, cycles, path, HOW, cancel=lambda: asked.append(1) or len(asked) > 2)
    told = json.loads((tmp_path / "m.ome.tif.manifest.json").read_text())
    assert [n for n, c in told["cycles"].items() if c["status"] == "complete"] == ["1", "2"]
    files = {f: f.stat().st_mtime_ns for f in stage.rglob("*.parquet")}
    assert [r["action"] for r in C.merge(spark, cycles, path, HOW, mode="dry")] == ["kept", "kept", "to build", "to build", "to build"]
    with pytest.raises(C.Cancelled):  # stop once more before the file, to see that nothing was written twice
        C.merge(spark, cycles, path, HOW, cancel=lambda: asked.append(1) or len(asked) > 5)
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in files.items())
    assert [r["action"] for r in C.merge(spark, cycles, path, HOW)] == ["kept"] * 4 + ["built"]
    assert np.array_equal(_read(spark, path, 0, base.shape), base)


def test_other_inputs_settings_and_force_build_all(spark, slide, tmp_path):
    _, _, _, cycles = slide
    path = str(tmp_path / "m.ome.tif")
    C.merge(spark, cycles[:2], path, HOW)
    changed = [C.Cycle(**{**vars(c), "version": "2"}) for c in cycles[:2]]
    assert [r["action"] for r in C.merge(spark, changed, path, HOW, mode="dry")] == ["to build"] * 3
    assert [r["action"] for r in C.merge(spark, changed, path, HOW)] == ["built"] * 3
    assert [r["action"] for r in C.merge(spark, changed, path, C.Settings(**{**vars(HOW), "levels": 1}))] == ["built"] * 3
    assert [r["action"] for r in C.merge(spark, changed, path, C.Settings(**{**vars(HOW), "levels": 1}), mode="force")] == ["built"] * 3


def test_a_folder_without_its_mark_and_a_broken_manifest_do_not_count(spark, slide, tmp_path):
    _, _, _, cycles = slide
    path, record = str(tmp_path / "m.ome.tif"), tmp_path / "m.ome.tif.manifest.json"
    asked = []
    with pytest.raises(C.Cancelled):
        C.merge(spark, cycles[:2], path, HOW, cancel=lambda: asked.append(1) or len(asked) > 2)
    (tmp_path / "m.ome.tif.cycles" / "cycle=2" / "_SUCCESS").unlink()
    assert [r["action"] for r in C.merge(spark, cycles[:2], path, HOW, mode="dry")] == ["kept", "to build", "to build"]
    record.write_text("{")
    assert C.load_manifest(spark, str(record)) is None
    assert [r["action"] for r in C.merge(spark, cycles[:2], path, HOW)] == ["built"] * 3


def test_what_cannot_be_merged_is_refused(spark, slide):
    _, _, _, cycles = slide
    twice = [cycles[0], cycles[0]]
    other = C.Cycle(**{**vars(cycles[1]), "dtype": "float32"})
    blind = C.Cycle(**{**vars(cycles[1]), "names": ("a", "b")})
    for bad in ([], twice, [cycles[0], other], [cycles[0], blind]):
        with pytest.raises(ValueError):
            C.plan(bad, HOW)
    with pytest.raises(ValueError):
        C.plan(cycles, C.Settings(reference=3))
    assert C.plan(cycles, C.Settings(reference=4)).order == [4, 1, 2, 9]
    assert C.plan([C.Cycle(**{**vars(cycles[0]), "names": ("DAPI", "DAPI")})], HOW).names == ["DAPI_cy1", "DAPI_cy1_2"]


def test_large_shifts_are_found_on_block_means_and_fractions_are_kept(spark):
    base = _plane(3, 512, 512)
    fixed = _cycle(spark, 1, [M.block_means(base, 1)[:256, :256].astype("uint16")], ("DAPI",)).tiles.drop("channel")
    moving = _cycle(spark, 2, [base[40:296, 24:280]], ("DAPI",)).tiles.drop("channel")
    assert M.slide_shift(fixed, moving, 256, 256, 64, 4, 1) == (40.0, 24.0)
    smooth = E.smoothed(base.astype(float), 2.0)
    y, x = np.mgrid[0:128, 0:128] + 100.0
    a, b = E.sample(smooth, y, x), E.sample(smooth, y + 1.5, x - 0.5)
    tiles = [_cycle(spark, k, [p.astype("float32")], ("DAPI",)).tiles.drop("channel") for k, p in enumerate((a, b))]
    dy, dx = M.slide_shift(*tiles, 128, 128, 64, 1, 10)
    assert abs(dy - 1.5) <= 0.3 and abs(dx + 0.5) <= 0.3


def test_touch_up_follows_a_bent_cycle(spark, tmp_path):
    smooth = E.smoothed(_plane(5, 160, 160).astype(float), 1.5)
    y, x = np.mgrid[0:128, 0:128] + 16.0
    base = E.sample(smooth, y, x)
    bent = E.sample(smooth, y + 2 + 1.2 * np.sin(x / 20), x - 1 + 1.2 * np.cos(y / 22))
    cycles = [_cycle(spark, k, [p.astype("uint16")], ("DAPI",)) for k, p in ((1, base), (2, bent))]
    path = str(tmp_path / "t.ome.tif")
    C.merge(spark, cycles, path, C.Settings(size=64, coarse=1, tile=32, touch_up=True, rigid_bound=4, bound=4.0))
    inner = np.s_[10:-10, 10:-10]
    corr = lambda p: np.corrcoef(p[inner].ravel(), base[inner].ravel())[0, 1]
    got = _read(spark, path, 1, base.shape)
    assert corr(got) > 0.9 > corr(bent)
