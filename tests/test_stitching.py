"""Stitching and touch-up on planted inputs, and what numbers and joins do on odd tables."""

import numpy as np
import pytest

from rastrel.operators import islands, pyramid, segmentation, stitching, touchup


def _texture(h, w, seed=3):
    rng = np.random.default_rng(seed)
    t = rng.random((h // 2 + 1, w // 2 + 1)).repeat(2, 0).repeat(2, 1)[:h, :w]
    return t * 1000 + 200


def _pixels(spark, tiles):
    return spark.createDataFrame([(t, y, x, float(p[y, x])) for t, p in tiles.items() for y in range(p.shape[0]) for x in range(p.shape[1])], "tile long, y int, x int, v double")


@pytest.mark.parametrize("overlap,aside", [(12, 0), (17, 1)])
def test_the_planted_step_is_found_on_both_axes(spark, overlap, aside):
    n = 100
    big = _texture(2 * n, 2 * n)
    cut = lambda oy, ox: big[20 + oy : 20 + oy + n, 20 + ox : 20 + ox + n]
    tiles = _pixels(spark, {0: cut(0, 0), 1: cut(aside, n - overlap), 2: cut(n - overlap, aside)})
    pairs = spark.createDataFrame([("x", 0, 1), ("y", 0, 2)], "axis string, src long, dst long")
    for r in stitching.neighbour_estimates(tiles, pairs, n, n, 300.0, least_px=6).collect():
        want = (aside, n - overlap) if r["axis"] == "x" else (n - overlap, aside)
        assert (abs(r["dy"] - want[0]), abs(r["dx"] - want[1])) <= (1.0, 1.0) and r["score"] > 0.8 and not r["unmasked"] and not r["fallback"] and r["fg_px"] > 0


def test_strips_without_signal_are_tried_unmasked_or_not_at_all(spark):
    tiles = _pixels(spark, {0: np.full((64, 64), 5.0), 1: np.full((64, 64), 5.0)})
    pairs = spark.createDataFrame([("x", 0, 1), ("x", 8, 9)], "axis string, src long, dst long")
    got = {r["src"]: r for r in stitching.neighbour_estimates(tiles, pairs, 64, 64, 300.0, least_px=4).collect()}
    assert got[0]["unmasked"] and got[0]["fg_px"] == 0 and not got[0]["fallback"]
    assert got[8]["fallback"] and (got[8]["dy"], got[8]["dx"], got[8]["overlap"]) == (0.0, 56.0, 8.0)


def test_overlaps_that_are_tried():
    assert stitching.overlap_candidates(2000, 100.0).tolist() == list(range(100, 401, 20))
    assert stitching.overlap_candidates(64, 8.0, 4).tolist() == list(range(4, 14))
    assert stitching.overlap_candidates(300, 15.0).tolist() == [100]


def test_shift_to_a_fraction_of_a_pixel():
    y, x = np.mgrid[0:64, 0:64]
    wave = lambda a, b: np.sin((y + a) * 2 * np.pi / 64) + np.cos((x + b) * 2 * np.pi / 64)
    dy, dx = stitching.cross_shift(wave(0, 0), wave(2.3, -1.6), 10)
    assert abs(dy - 2.3) < 0.11 and abs(dx + 1.6) < 0.11


def _blobs(h, w):
    y, x = np.mgrid[0:h, 0:w]
    out = np.full((h, w), 120.0)
    for cy, cx, r, v in ((40, 50, 14, 18000), (90, 60, 16, 22000), (60, 110, 15, 20000), (120, 120, 17, 26000)):
        out += v * np.exp(-(((y - cy) ** 2 + (x - cx) ** 2) / (2 * r * r)))
    return out + 900 * np.sin(y / 3.0) * np.cos(x / 4.0)


@pytest.mark.parametrize("shift,bound,found", [((-12, 8), 32, True), ((0, 0), 32, False), ((-30, 30), 8, None)])
def test_touchup_accepts_rejects_and_stays_in_bounds(spark, shift, bound, found):
    fixed = _blobs(160, 160)
    moving = stitching.moved(fixed, *shift)
    dy, dx, base, best = touchup.best_shift(touchup.score_surface(fixed, moving, np.ones(fixed.shape, bool), bound))
    assert max(abs(dy), abs(dx)) <= bound and best >= base
    if found is not None:
        assert ((dy, dx) == (-shift[0], -shift[1])) and ((dy, dx) != (0, 0)) == found


def test_score_surface_is_the_masked_correlation_of_every_shift():
    rng = np.random.default_rng(4)
    fixed, moving, use = rng.random((17, 23)), rng.random((17, 23)), rng.random((17, 23)) < 0.6
    got = touchup.score_surface(fixed, moving, use, 5)
    want = [[stitching.correlation(fixed[use], stitching.moved(moving, dy, dx)[use]) for dx in range(-5, 6)] for dy in range(-5, 6)]
    assert np.allclose(got, want, atol=1e-9)
    assert touchup.best_shift(np.zeros((3, 3))) == (0, 0, 0.0, 0.0)
    assert touchup.best_shift(np.array([[0.9, 0, 0.9], [0, 0.1, 0.5], [0, 0.9, 0]])) == (1, 0, 0.1, 0.9)


def test_a_halo_gives_what_is_shifted_in(spark):
    big = _texture(60, 60)
    at = lambda y, x: float(big[20 + y, 20 + x])
    inside = lambda y, x: 0 <= y < 12 and 0 <= x < 12
    rows = spark.createDataFrame([(1, y, x, at(y, x) if inside(y, x) else None, at(y + 3, x - 2), inside(y, x)) for y in range(-4, 16) for x in range(-4, 16)], "tile long, y int, x int, a double, b double, m boolean")
    (r,) = touchup.rigid_touchup(rows, 12, 4, halo=4).collect()
    assert (r["dy"], r["dx"], r["accepted"]) == (3.0, -2.0, True) and r["corr"] > 0.95


def test_touchup_without_a_mask_gives_no_shift(spark):
    rows = spark.createDataFrame([(1, y, x, float(y), float(x), y < 2 and x < 4) for y in range(9) for x in range(9)], "tile long, y int, x int, a double, b double, m boolean")
    (r,) = touchup.rigid_touchup(rows, 9, 2).collect()
    assert (r["dy"], r["dx"], r["accepted"]) == (0.0, 0.0, False)


def test_gates():
    assert (touchup.LEAST_GAIN, touchup.LEAST_CORR, touchup.LEAST_SIGNAL) == (0.01, 0.5, 1024)


def test_unreached_tiles_stand_at_the_origin(spark):
    tiles = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (9, 5, 5)], "tile long, gy long, gx long")
    got = {r["tile"]: (r["y"], r["x"], r["round"]) for r in stitching.interpolate_unplaced(tiles, spark.createDataFrame([(0, 2.0, 3.0)], "tile long, y double, x double"), 10.0, 20.0).collect()}
    assert got == {0: (2.0, 3.0, 0), 1: (2.0, 23.0, 1), 9: (0.0, 0.0, -1)}


def test_numbers_are_dense_and_in_order(spark):
    for n in (0, 1, 5000):
        got = islands.numbered(spark.range(n).selectExpr("id * 3 - 700 as k").union(spark.range(n).selectExpr("id * 3 - 700 as k")), "k").collect()
        assert sorted((r["k"], r["number"]) for r in got) == [(3 * i - 700, i + 1) for i in range(n)]


def test_level_shapes_halve_until_the_short_side_is_small(spark):
    sizes = [(1, 1), (128, 4000), (129, 129), (1000, 257), (40_000, 61_111)]
    images = spark.createDataFrame([(k, h, w) for k, (h, w) in enumerate(sizes)], "image long, h long, w long")
    want = set()
    for k, (h, w) in enumerate(sizes):
        level = 0
        want.add((k, level, h, w))
        while h > 128 and w > 128:
            h, w, level = max(1, (h + 1) // 2), max(1, (w + 1) // 2), level + 1
            want.add((k, level, h, w))
    assert {tuple(r) for r in pyramid.level_shapes(images).collect()} == want


def test_a_boundary_parts_nuclei_that_no_neck_does(spark):
    y, x = np.mgrid[:30, :44]
    mask = ((y - 14) ** 2 + (x - 13) ** 2 <= 81) | ((y - 14) ** 2 + (x - 27) ** 2 <= 81) | ((abs(y - 14) <= 9) & (x >= 13) & (x <= 27))
    rows = [(int(a), int(b), 0.9, 0.9 if b == 20 else 0.0, 0.7 if a < 8 else 0.0) for a, b in np.argwhere(mask)]
    probs = spark.createDataFrame(rows, "y long, x long, p double, boundary double, background double")
    got = segmentation.boundary_nuclei(probs, 30, 44, spacing=6).toPandas()
    left, right = set(got[got.x < 18].label), set(got[got.x > 22].label)
    assert got.y.min() == 8 and left and right and not left & right
