"""Cells grow to the reach of their nuclei and no further, at the edge of the plane too."""

from rastrel.operators.segmentation import grow_cells


def test_cells_end_at_their_reach(spark):
    h, w = 20, 40
    plane = spark.range(h * w).selectExpr("id div 40 as y", "id % 40 as x", "0.5D as p")
    at = {(10, 8): 1, (10, 30): 2}
    nuclei = spark.createDataFrame([(y, x, k) for (y, x), k in at.items()], "y long, x long, label long")
    got = {(r["y"], r["x"]): r["label"] for r in grow_cells(nuclei, plane, h, w, reach=3).collect()}
    want = {(y, x): k for (a, b), k in at.items() for y in range(h) for x in range(w) if (y - a) ** 2 + (x - b) ** 2 <= 9}
    assert got == want
