"""Edits carried to the whole image from the feature store, with the forest's score on pixels that it did not see."""

import numpy as np
import pytest

from rastrel.operators import propagation as P
from rastrel.plans import inputs as I
from rastrel.plans import propagation as Q
from rastrel.sources import bigtiff as B
from rastrel.sources import features as S

from .conftest import DATA, rows

D, SIZE = f"{DATA}/sf0.01", 32


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    height = I.disc_height(spark, D)
    plane = I.disc_plane(spark, D).selectExpr("0 as channel", "y", "x", "v div 100 as v")
    tiles = B.tiles_of(plane, B.Layout(1, height, I.W, "uint16", SIZE, 1, ("DAPI",))).cache()
    store, recipe = S.FeatureStore(spark, str(tmp_path_factory.mktemp("f") / "s")), S.Recipe((1.0, 2.0), SIZE)
    assert store.fill(tiles, "a", recipe) == 2 * tiles.count()
    return height, P.store_vectors(store, "a", recipe, [0]), store, recipe


def test_places_within_reach_are_a_disc(spark):
    mask = spark.createDataFrame([(5, 5), (0, 11)], "y long, x long")
    want = sorted({(y, x) for y in range(9) for x in range(12) for a, b in ((5, 5), (0, 11)) if (y - a) ** 2 + (x - b) ** 2 <= 9})
    assert sorted((r["y"], r["x"]) for r in P.within(mask, 3, 9, 12).collect()) == want


def test_edits_are_carried_on_and_scored_on_unseen_pixels(spark, stored, tmp_path):
    height, vectors, _, _ = stored
    base, edited = Q._labels(spark, D)
    told = P.fit_edits(vectors, base, edited, height, I.W, 4, 600, trees=20)
    assert told.record["pixels"] == {str(r["class"]): r["count"] for r in told.sample.groupBy("class").count().collect()}
    assert max(told.record["pixels"].values()) <= 200
    score = P.held_out_score(told, vectors, P.edit_classes(base, edited, height, I.W, 4)).collect()
    n, right = sum(r["n"] for r in score), sum(r["right"] for r in score)
    # Deleted discs look like nuclei but are background by the edit, so no forest tells all of them apart.
    assert n > 300 and right / n > 0.6
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        P.load_model(spark, path)
    P.save_model(told, path, spark, channels=["DAPI"])
    model, record = P.load_model(spark, path)
    assert record["channels"] == ["DAPI"] and record["budget"] == 600
    some = vectors.where("y < 40")
    assert rows(P.predict_by_focus(model, some, SIZE, (10.0, 10.0)).toPandas()) == rows(P.predict_by_focus(told.model, some, SIZE, (10.0, 10.0)).toPandas())


def test_outlined_nuclei_are_learnt(spark, stored):
    height, vectors, _, _ = stored
    edited = I.discs(spark, D).select("y", "x", "label")
    base = edited.where("label % 3 <> 0")  # every third one was added by hand
    told = P.fit_edits(vectors, base, edited, height, I.W, 4, 600, trees=20)
    score = P.held_out_score(told, vectors, P.edit_classes(base, edited, height, I.W, 4)).collect()
    assert {r["class"] for r in score} == {1, 2, 3}
    assert sum(r["right"] for r in score) / sum(r["n"] for r in score) > 0.9
    tiles = P.predict_by_focus(told.model, vectors, SIZE, (height / 2, I.W / 2))
    assert tiles.count() == height * I.W
    parts = tiles.rdd.mapPartitions(lambda it: [(lambda d: (min(d), max(d)) if d else None)([r["d2"] for r in it])]).collect()
    spans = [p for p in parts if p]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_nothing_edited_is_an_error_and_a_tile_without_a_scale_is_left_out(spark, stored):
    height, vectors, store, recipe = stored
    base, _ = Q._labels(spark, D)
    with pytest.raises(ValueError):
        P.fit_edits(vectors, base, base, height, I.W)
    wider = S.Recipe((1.0, 3.0), SIZE)
    assert P.store_vectors(store, "a", wider, [0]).count() == 0


def test_vectors_are_what_the_store_has(spark, stored):
    _, vectors, store, recipe = stored
    points = spark.createDataFrame([(3, 5), (40, 60)], "y long, x long")
    want = {(r["y"], r["x"]): list(r["f0"]) + list(r["f1"]) for r in store.at(points, "a", recipe, 0).collect()}
    got = {(r["y"], r["x"]): r["features"].toArray().tolist() for r in vectors.join(points, ["y", "x"]).collect()}
    assert got == want and np.isfinite(sum(want.values(), [])).all()
