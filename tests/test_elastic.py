"""Elastic touch-up on planted distortions."""

import numpy as np
import pytest

from rastrel.operators import elastic as E

H, W, SIZE = 300, 340, 128


def islands():
    y, x = np.mgrid[0:H, 0:W].astype(float)
    rng = np.random.default_rng(7)
    out = np.zeros((H, W))
    for _ in range(260):
        cy, cx, r = rng.uniform(0, H), rng.uniform(0, W), rng.uniform(3, 7)
        if min(np.hypot((cy - 100) / 85, (cx - 110) / 95), np.hypot((cy - 205) / 80, (cx - 240) / 85)) < 1:
            out += rng.uniform(2000, 9000) * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * r * r))
    return out


def planted(fixed):
    """``fixed`` read through a smooth field with a whole shift."""
    y, x = np.mgrid[0:H, 0:W].astype(float)
    return E.sample(fixed, y + 5 + 3 * np.sin(y / 60) * np.cos(x / 75), x - 4 + 3 * np.cos(y / 70) * np.sin(x / 65))


def tiles(spark, plane, size=64):
    plane = plane.astype("<f4")
    rows = [(y, x, *plane[y : y + size, x : x + size].shape, "float32", plane[y : y + size, x : x + size].tobytes()) for y in range(0, H, size) for x in range(0, W, size)]
    return spark.createDataFrame(rows, E.TILE)


def plane_of(df):
    out = np.zeros((H, W))
    rows = df.collect()
    for r in rows:
        out[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["px"], "<f4").reshape(r["h"], r["w"])
    assert sum(r["h"] * r["w"] for r in rows) == H * W
    return out


def test_planted_distortion_is_undone_whatever_the_number_of_tasks(spark):
    fixed = islands()
    moving, mask = planted(fixed), fixed > 1000
    before = E.masked_corr(fixed, moving, mask)
    scores = []
    for n in (1, 3):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = plane_of(E.touch_up(*(tiles(spark, p).repartition(n) for p in (fixed, moving, mask)), H, W, SIZE, 12, 8.0, least_signal=200))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        scores.append(E.masked_corr(fixed, got, mask))
    assert scores[0] > before + 0.05 and scores[0] >= 0.9 and abs(scores[0] - scores[1]) < 1e-6


def test_the_kernel_can_be_replaced_and_gates_hold(spark):
    E.KERNELS["nothing"] = lambda fixed, moving, use, bound: (np.zeros(fixed.shape), np.zeros(fixed.shape))
    fixed = islands()
    args = [tiles(spark, p) for p in (fixed, planted(fixed), fixed > 1000)]
    try:
        states = {n: [r["state"] for r in E.elastic_fields(*args, H, W, SIZE, 12, 8.0, n, 200).select("state").collect()] for n in ("nothing", "bspline")}
    finally:
        del E.KERNELS["nothing"]
    assert len(states["nothing"]) == 4 * 5 and not any("elastic" in s for s in states["nothing"])
    assert "rigid+elastic" in states["bspline"]
    same = E.elastic_fields(args[0], args[0], args[2], H, W, SIZE, 12, 8.0, least_signal=200).collect()
    assert {r["state"] for r in same} <= {"stable", "abstain"} and all(not any(r["field_y"]) for r in same)
    with pytest.raises(KeyError):
        E.elastic_fields(*args, H, W, SIZE, 12, 8.0, "unknown")


def test_basis_and_weights_sum_to_one():
    assert np.allclose(E.spline_basis(100, 24.0).sum(1), 1)
    n, half = E.lattice(300, 64), 64
    total = np.zeros((n + 1) * half)
    for k in range(n):
        total[k * half : k * half + 128] += E.trust(k, n, 128)
    assert np.allclose(total, 1) and n * half + half >= 300


def test_a_known_field_is_applied_across_tiles(spark):
    plane = islands()
    fields = [(ty, tx, np.full((64, 64), 3.5, "<f4").tobytes(), np.full((64, 64), -2.25, "<f4").tobytes()) for ty in range(5) for tx in range(6)]
    fields = spark.createDataFrame(fields, "ty long, tx long, field_y binary, field_x binary")
    got = plane_of(E.apply_field(tiles(spark, plane, 50), fields, H, W, 64, 4))
    y, x = np.mgrid[0:H, 0:W]
    assert np.allclose(got, E.sample(plane.astype("f4").astype(float), y - 3.5, x + 2.25), atol=0.01)


def test_the_query_undoes_the_planted_field(spark):
    from rastrel.plans.registered import QUERIES

    from .conftest import DATA

    rows = QUERIES["elastic_field"](spark, f"{DATA}/sf0.001").collect()
    assert len(rows) > 0 and all(r["state"] in ("elastic", "rigid+elastic", "rigid", "stable", "abstain") for r in rows)
    assert np.median([r["elastic"] for r in rows if r["state"] != "abstain"]) > 0.9
