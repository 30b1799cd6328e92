"""Nearest sources and spaced peaks against plain loops, on ties and plateaus."""

import random

from rastrel.operators import nearest as NE


def test_nearest_source_on_ties_and_edges(spark):
    rng = random.Random(3)
    for n in (1, 2, 9):
        places = [(rng.randrange(13), rng.randrange(17)) for _ in range(n)] + [(99, 3)]
        got = NE.nearest_source(spark.createDataFrame(places, "y int, x int"), 13, 17).collect()
        want = {(y, x): min(((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in places[:-1]) for y in range(13) for x in range(17)}
        assert {(r["y"], r["x"]): (r["d2"], r["sy"], r["sx"]) for r in got} == want and len(got) == 13 * 17
    assert NE.nearest_source(spark.createDataFrame([], "y int, x int"), 5, 5).collect() == []


def greedy(peaks, spacing):
    kept = []
    for y, x, v in sorted(set(peaks), key=lambda p: (-p[2], p[0], p[1])):
        if all(abs(y - a) > spacing or abs(x - b) > spacing for a, b, _ in kept):
            kept.append((y, x, v))
    return sorted(kept)


def test_spaced_peaks_are_those_of_plain_greedy_choice(spark):
    rng = random.Random(8)
    scattered = list({(y, x): (y, x, rng.randrange(6)) for y, x in ((rng.randrange(-20, 40), rng.randrange(40)) for _ in range(200))}.values())
    plateau = [(y, x, 5) for y in range(12) for x in range(12)]
    chain = [(0, 3 * k, 100 - k) for k in range(12)]
    for peaks in (scattered, plateau, chain, scattered[:5] * 3):
        for spacing in (1, 4):
            got = sorted(tuple(r) for r in NE.spaced_peaks(spark.createDataFrame(peaks, "y int, x int, v int"), spacing).collect())
            assert got == greedy(peaks, spacing)
    assert NE.spaced_peaks(spark.createDataFrame([], "y int, x int, v int"), 2).collect() == []
