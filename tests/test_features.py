"""The feature store: values, what a second run computes, a changed scale, dropped channels, points."""

import numpy as np
import pyarrow as pa
import pytest

from rastrel.operators import elastic as E
from rastrel.operators import learning as L
from rastrel.operators import merging as M
from rastrel.sources import features as S

SIZE, H, W = 24, 24, 40


@pytest.fixture(scope="module")
def image(spark):
    planes = np.random.default_rng(2).integers(0, 60, (2, H, W)).astype("uint16")
    rows = [{"channel": c, "y0": 0, "x0": x, "h": H, "w": min(SIZE, W - x), "dtype": "uint16", "px": planes[c, :, x : x + SIZE].tobytes()} for c in (0, 1) for x in (0, SIZE)]
    return planes, spark.createDataFrame(pa.Table.from_pylist(rows, E._schema(M.MOVED)).to_pandas(), M.MOVED)


def _values(store, key, recipe, channel, sigma, tx):
    (r,) = store.read(key, recipe, channel, sigma).where(f"tx = {tx}").collect()
    return np.frombuffer(r["data"], "<f2").reshape(len(S.MAPS), r["h"], r["w"]).astype(float)


def test_values_are_those_of_the_feature_stack_of_the_tile(spark, image, tmp_path):
    planes, tiles = image
    store, recipe, key = S.FeatureStore(spark, str(tmp_path / "s")), S.Recipe((0.7, 1.6), SIZE), S.image_key(tiles)
    assert store.fill(tiles, key, recipe) == 8
    own = planes[1, :, :SIZE]
    px = spark.createDataFrame([(y, x, int(own[y, x])) for y in range(H) for x in range(SIZE)], "y long, x long, v long")
    want = L.feature_stack(px, [0.7, 1.6], H, SIZE).toPandas().sort_values(["y", "x"])
    for k, sigma in enumerate(recipe.sigmas):
        got = _values(store, key, recipe, 1, sigma, 0)
        for m, name in enumerate(S.MAPS):
            assert np.allclose(got[m].ravel(), want[f"{name}{k}"].to_numpy(), rtol=2e-3, atol=2e-3), (name, sigma)


def test_only_what_is_missing_is_computed(spark, image, tmp_path):
    _, tiles = image
    store, key = S.FeatureStore(spark, str(tmp_path / "s")), S.image_key(tiles)
    assert store.fill(tiles.where("x0 = 0"), key, S.Recipe((0.7, 1.6), SIZE)) == 4
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    assert store.fill(tiles, key, S.Recipe((0.7, 1.6), SIZE)) == 4
    assert store.fill(tiles, key, S.Recipe((0.7, 1.6), SIZE)) == 0
    assert store.fill(tiles, key, S.Recipe((0.7, 2.5), SIZE)) == 4  # the changed scale alone
    assert store.fill(tiles, key, S.Recipe((0.7, 2.5), SIZE, ((1, 0.0, 50.0),))) == 4  # the channel with limits alone
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())


def test_other_pixels_are_another_image_and_equal_ones_the_same(spark, image, tmp_path):
    _, tiles = image
    assert S.image_key(tiles.repartition(3)) == S.image_key(tiles)
    assert S.image_key(tiles.withColumn("px", S.F.reverse("px"))) != S.image_key(tiles)
    store, recipe = S.FeatureStore(spark, str(tmp_path / "s")), S.Recipe((0.7,), SIZE)
    assert store.fill(tiles, "a", recipe) == 4
    assert store.fill(tiles, "b", recipe) == 4
    assert store.drop("a", recipe.key(0.7, 0), 0) and not store.drop("a", recipe.key(0.7, 0), 0)
    assert store.missing(tiles, "a", recipe).select("channel").distinct().collect() == [(0,)]
    assert store.fill(tiles, "a", recipe) == 2
    assert store.drop("a") and store.count("a") == 0 and store.count("b") == 4


def test_points_take_the_values_of_their_tile(spark, image, tmp_path):
    _, tiles = image
    store, recipe = S.FeatureStore(spark, str(tmp_path / "s")), S.Recipe((0.7, 1.6), SIZE)
    store.fill(tiles, "a", recipe)
    points = spark.createDataFrame([(3, 5, "p"), (23, 39, "q"), (3, 5, "r"), (200, 5, "beyond")], "y long, x long, name string")
    got = {r["name"]: r for r in store.at(points, "a", recipe, 1).collect()}
    assert set(got) == {"p", "q", "r"}
    for name, (y, x) in {"p": (3, 5), "q": (23, 39), "r": (3, 5)}.items():
        for k, sigma in enumerate(recipe.sigmas):
            assert got[name][f"f{k}"] == _values(store, "a", recipe, 1, sigma, x // SIZE)[:, y, x % SIZE].tolist()


def test_tiles_off_the_grid_are_refused_and_empty_images_do_nothing(spark, image, tmp_path):
    _, tiles = image
    store = S.FeatureStore(spark, str(tmp_path / "s"))
    assert store.fill(tiles.where("false"), "a", S.Recipe((0.7,), SIZE)) == 0
    with pytest.raises(Exception, match="not one of the grid"):
        store.fill(tiles, "a", S.Recipe((0.7,), SIZE - 1))
