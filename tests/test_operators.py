"""Operators without SQL, and the acceptance figures of planted inputs."""

import numpy as np

from rastrel.operators import edits, geometry, graph, learning, registration, segmentation
from rastrel.plans import inputs
from rastrel.plans.catalog import QUERIES
from rastrel.streaming import progress

from .conftest import DATA

TILE = "tile long, island long, y0 long, x0 long, cy double, cx double, dy double, dx double, gain double, state string"


def _tiles(spark, rows):
    return spark.createDataFrame([(t, i, 0, 10 * t, 5.0, 10.0 * t + 5, dy, dx, g, s) for t, i, dy, dx, g, s in rows], TILE)


def _shifts(df):
    return {r["tile"]: (round(r["dy"], 6), round(r["dx"], 6)) for r in df.collect()}


def test_borrowed_shifts_come_from_the_own_island_and_are_clamped(spark):
    tiles = _tiles(spark, [(0, 1, 20.0, -6.0, 0.5, "accepted"), (1, 1, 0.0, 0.0, 0.0, "borrowed"), (2, 1, 0.0, 0.0, 0.0, "borrowed"), (3, 2, 0.0, 0.0, 0.0, "borrowed"), (9, 1, 0.0, 0.0, 0.0, "borrowed")])
    got = _shifts(graph.borrow_shifts(tiles, 10.0, 25.0))
    assert got[1] == got[2] == got[9] == (20.0, -6.0) and got[3] == (0.0, 0.0)
    size = np.hypot(*_shifts(graph.borrow_shifts(tiles, 10.0, 5.0))[1])
    assert abs(size - 5.0) < 1e-5


def test_two_equal_seeds_average(spark):
    tiles = _tiles(spark, [(0, 1, 10.0, 0.0, 0.5, "accepted"), (1, 1, 0.0, 0.0, 0.0, "borrowed"), (2, 1, 30.0, 0.0, 0.5, "accepted")])
    assert _shifts(graph.borrow_shifts(tiles, 10.0, 99.0))[1] == (20.0, 0.0)
    assert _shifts(graph.smooth_prior(tiles, 10.0))[1] == (20.0, 0.0)


def test_phase_correlation_finds_a_wrapped_shift():
    rng = np.random.default_rng(1)
    a = rng.random((40, 56))
    assert np.round(registration.phase_shift(a, np.roll(a, (3, -5), (0, 1)))).tolist() == [-3.0, 5.0]


def test_warp_is_the_inverse_of_a_shift(spark):
    px = inputs.disc_plane(spark, f"{DATA}/sf0.01")
    from pyspark.sql import functions as F

    field = px.select("y", "x", F.lit(2.0).alias("dy"), F.lit(-3.0).alias("dx"))
    got = {(r["y"], r["x"]): r["v"] for r in registration.warp(px, field).collect()}
    want = {(r["y"], r["x"]): r["v"] for r in geometry.shift(px, 2, -3, inputs.disc_height(spark, f"{DATA}/sf0.01"), inputs.W).collect()}
    assert all(got[k] == v for k, v in want.items()) and all(v == 0 for k, v in got.items() if k not in want)


def test_distance_is_exact():
    rng = np.random.default_rng(2)
    mask = rng.random((13, 17)) < 0.8
    wide = np.pad(mask, 1)
    out = np.argwhere(~wide)
    want = np.array([[min(np.hypot(*(out - (y + 1, x + 1)).T)) if mask[y, x] else 0.0 for x in range(17)] for y in range(13)])
    assert np.allclose(segmentation.distance(mask), want)


def test_touching_discs_are_told_apart(spark):
    y, x = np.mgrid[:30, :50]
    mask = ((y - 14) ** 2 + (x - 14) ** 2 <= 100) | ((y - 14) ** 2 + (x - 32) ** 2 <= 100)
    prob = spark.createDataFrame([(int(a), int(b), 0.9) for a, b in np.argwhere(mask)], "y long, x long, p double")
    sizes = sorted(r["count"] for r in segmentation.nuclei(prob, 30, 50).groupBy("label").count().collect())
    assert len(sizes) == 2 and sizes[0] > 250


def test_split_by_line_keeps_the_larger_part(spark):
    labels = spark.createDataFrame([(y, x, 1) for y in range(12) for x in range(10)] + [(y, 20, 2) for y in range(4)], "y long, x long, label long")
    line = geometry.draw_polyline(spark, [(4, 0), (4, 15)])
    got = edits.split_by_line(labels, line, 20, 30, least=5).toPandas()
    assert got[got.label == 1].y.min() == 5 and (got[got.label == 3].y < 4).all() and len(got[got.y == 4]) == 0
    assert len(got[got.label == 2]) == 4


def test_components_of_an_empty_mask(spark):
    empty = spark.createDataFrame([], "y long, x long")
    assert graph.components(empty, 10, 10).count() == 0 and graph.farthest_cells(empty, 3).count() == 0


def test_solved_positions_follow_the_edges(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, 90.0, 1.0), (1, 2, -1.0, 91.0, 1.0), (0, 2, 0.0, 181.0, 1.0)], "src long, dst long, dy double, dx double, w double")
    placed = graph.place_from_seed(spark.range(3).withColumnRenamed("id", "tile"), edges, 0)
    at = {r["tile"]: (r["y"], r["x"]) for r in graph.to_origin(graph.relax(placed.select("tile", "y", "x"), edges, 0)).collect()}
    assert at == {0: (0, 0), 1: (1, 90), 2: (0, 181)}


def test_forest_learns_planted_classes(spark):
    from pyspark.sql import functions as F

    d = f"{DATA}/sf0.01"
    plane = inputs.disc_plane(spark, d)
    got = QUERIES["pixel_classes"](spark, d).join(plane, ["y", "x"])
    assert got.where((F.col("v") < 1000) & (F.col("p2") < 0.5)).count() < 0.02 * got.count()


def test_missing_classes_get_probability_zero(spark):
    rows = spark.createDataFrame([(k, [float(k % 2), 1.0], k % 2) for k in range(40)], "vec_id long, embedding array<float>, label int")
    got = learning.classify_vectors(rows, "vec_id", "embedding", "label", 3, trees=3).toPandas()
    assert (got.p2 == 0).all() and ((got.p0 + got.p1).round(6) == 1).all()


def test_progress_stream_keeps_the_newest_event(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.01/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    query = progress.latest_by_phase(progress.progress_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.table("newest")
    assert got.agg({"n": "sum"}).first()[0] == events.count()
    assert got.groupBy("run", "phase", "hour").count().where("count > 1").count() == 0


def test_feature_stack_of_a_parabola(spark):
    """With a and b the distances from the centre, v = a*a + 3*a*b + 5*a: there the derivatives are those of the formula.

    The plane is 0 at the centre, since the weights of a truncated second derivative do not sum to 0 exactly.
    """
    from pyspark.sql import functions as F

    px = spark.range(24).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("x")).selectExpr("y", "x", "cast((y - 12) * (y - 12) + 3 * (y - 12) * (x - 12) + 5 * (y - 12) as double) as v")
    stack = learning.feature_stack(px, [1.0], 24, 24)
    assert len(stack.columns) == 2 + 1 + 8
    got = stack.where("y = 12 and x = 12").first()
    assert abs(got["grad0"] - 5) < 0.02
    want = np.linalg.eigvalsh([[2.0, 3.0], [3.0, 0.0]])
    assert abs(got["log0"] - 2) < 0.02 and abs(got["he_big0"] - want[1]) < 0.02 and abs(got["he_small0"] - want[0]) < 0.02
    assert got["st_big0"] >= got["st_small0"] >= 0 and abs(got["dog0"] - (1 - 1.6**2)) < 0.02
