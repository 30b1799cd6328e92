"""Components on blocks against a plain fill."""

import random

import pytest

from rastrel.operators import graph as GR


def fill(places, width, diagonal):
    """The smallest pixel number of each place's component."""
    sides = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    out = {}
    for y, x in sorted(places):
        if (y, x) not in out:
            name, todo = y * width + x, [(y, x)]
            out[y, x] = name
            while todo:
                y, x = todo.pop()
                for p in ((y + a, x + b) for a, b in sides):
                    if p in places and p not in out:
                        out[p] = name
                        todo.append(p)
    return out


def spiral(n):
    """A line of one pixel that winds inwards through every block."""
    out, y, x, dy, dx = set(), 0, 0, 0, 1
    while True:
        out.add((y, x))
        for _ in range(2):
            ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
            if 0 <= ny < n and 0 <= nx < n and (ny, nx) not in out and (fy, fx) not in out:
                y, x = ny, nx
                break
            dy, dx = dx, -dy
        else:
            return out


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("block", [4, 512])
def test_components_are_those_of_a_fill(spark, diagonal, block):
    rng = random.Random(block)
    places = {(y, x) for y in range(30) for x in range(40) if rng.random() < (0.4 if diagonal else 0.55)} | {(y + 32, x) for y, x in spiral(24)}
    mask = spark.createDataFrame([*places, *list(places)[:50]], "y long, x long")
    got = {(r["y"], r["x"]): r["label"] for r in GR.components(mask, 60, 40, diagonal, block).collect()}
    assert got == fill(places, 40, diagonal)


def test_an_empty_mask_has_no_components(spark):
    assert GR.components(spark.createDataFrame([], "y long, x long"), 8, 8, block=4).collect() == []
