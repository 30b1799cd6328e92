"""The report on a touch-up: bounds, missing results, small masks, empty tables."""

import numpy as np

from rastrel.operators import diagnostics as DG

TILE = "tile long, y long, x long, a double, b double, m boolean"
SWEPT = "tile long, bound long, dy long, dx long, mag double, base double, corr double, gain double, hit boolean"
FINAL = "tile long, final double"


def tile(number, shift, mask=None, side=20):
    plane = np.random.default_rng(number).random((side + 8, side + 8))
    plane = plane + np.roll(plane, 1, 0) + np.roll(plane, 1, 1)
    moved = np.roll(plane, (-shift[0], -shift[1]), (0, 1))
    return [(number, y, x, float(plane[y, x]), float(moved[y, x]), 4 <= y < 16 and 4 <= x < 16 if mask is None else (y, x) in mask) for y in range(side) for x in range(side)]


def test_each_bound_finds_what_lies_within_it(spark):
    rows = spark.createDataFrame(tile(1, (3, -2)) + tile(2, (0, 0)) + tile(3, (1, 1), mask={(5, 5)}), TILE)
    got = {(r["tile"], r["bound"]): r for r in DG.bound_sweep(rows, 20, [3, 4]).collect()}
    assert set(got) == {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert [(got[1, b]["dy"], got[1, b]["dx"], got[1, b]["hit"]) for b in (3, 4)] == [(3, -2, True), (3, -2, False)]
    assert (got[2, 4]["dy"], got[2, 4]["dx"], got[2, 4]["gain"]) == (0, 0, 0.0)
    assert got[1, 4]["corr"] > 0.95 > got[1, 4]["base"]


def test_classes_follow_their_rules(spark):
    # By tile: base, then (bound, corr, hit) of two bounds, then the final correlation.
    cases = {
        1: (0.5, (128, 0.6, False), (256, 0.6, False), 0.85, "well_registered"),
        2: (0.5, (128, 0.6, True), (256, 0.6, False), 0.7, "rigid_bound_limited"),
        3: (0.5, (128, 0.6, False), (256, 0.7, False), None, "rigid_bound_limited"),
        4: (0.96, (128, 0.97, False), (256, 0.97, False), 0.5, "skipped_incorrectly_suspect"),
        5: (0.6, (128, 0.62, False), (256, 0.62, False), 0.7, "upstream_rigid_or_low_texture_suspect"),
        6: (0.5, (128, 0.6, False), (256, 0.6, False), 0.7, "elastic_or_blending_suspect"),
    }
    sweep = [(k, b, 1, 0, 1.0, base, corr, corr - base, hit) for k, (base, *two, _, _) in cases.items() for b, corr, hit in two]
    final = [(k, f) for k, (*_, f, _) in cases.items() if f is not None]
    got = {r["tile"]: r for r in DG.diagnose(spark.createDataFrame(sweep, SWEPT), spark.createDataFrame(final, FINAL)).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {k: c[-1] for k, c in cases.items()}
    assert {k: r["bound"] for k, r in got.items()} == {1: 128, 2: 128, 3: 256, 4: 128, 5: 128, 6: 128}


def test_seams_without_a_final_correlation_are_suspect_by_their_jump(spark):
    rows = [(1, 0, 0, 0, 0, 0.9), (2, 0, 10, 70, 0, 0.7), (3, 10, 0, 0, 80, None), (4, 10, 10, 0, 0, 0.7)]
    got = {(r["tile"], r["side"]): (r["jump"], r["delta"], r["suspect"]) for r in DG.suspect_seams(spark.createDataFrame(rows, "tile long, y0 long, x0 long, dy long, dx long, final double"), 10).collect()}
    assert got == {(1, "right"): (70.0, 0.2, True), (1, "down"): (80.0, None, True), (2, "down"): (70.0, 0.0, False), (3, "right"): (80.0, None, True)}


def test_empty_tables_give_empty_reports(spark):
    sweep = DG.bound_sweep(spark.createDataFrame([], TILE), 20, [2])
    tiles = DG.diagnose(sweep, spark.createDataFrame([], FINAL))
    assert sweep.collect() == tiles.collect() == DG.worst_first(tiles, 3).collect() == []
    placed = tiles.selectExpr("*", "tile as y0", "tile as x0")
    assert [tuple(r)[2:] for r in DG.heat_map(placed, 20, 10, 10).collect()] == [(0, 0, 0)] * 2
    assert {tuple(r) for r in DG.summary(tiles, DG.suspect_seams(placed, 10)).collect()} == {("tiles", 0), ("pairs", 0), ("suspect pairs", 0)}
