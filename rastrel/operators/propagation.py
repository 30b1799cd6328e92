"""Edits of labels carried to the whole image: training pixels near what changed, a forest, and its tiles from the focus outwards.

Classes are 1 nucleus, 2 inner boundary, 3 background.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import by_sort
from ..scratch import Steps
from ..sources.cycles import load_manifest, save_manifest
from ..sources.features import MAPS, FeatureStore, Recipe
from .edits import difference
from .learning import predict, train_forest
from .metadata import sample_by_class
from .neighbourhood import inner_boundary

CLASSES = 3


def within(mask: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """Places inside the image that are no further than ``reach`` from a pixel of ``mask``, itself included.

    A pass along columns keeps the smallest distance, one along rows adds to it:
    a pixel is sent to ``2 * (2 * reach + 1)`` places, not to the whole disc.
    """
    offsets = range(-reach, reach + 1)
    down = mask.select("x", F.explode(F.array(*[F.struct((F.col("y") + k).alias("y"), F.lit(k * k).alias("d")) for k in offsets])).alias("p")).select("x", "p.*")
    down = down.where(F.col("y").between(0, height - 1)).groupBy("y", "x").agg(F.min("d").alias("d"))
    across = down.select("y", "d", F.explode(F.array(*[F.struct((F.col("x") + k).alias("x"), F.lit(k * k).alias("e")) for k in offsets])).alias("p")).select("y", "d", "p.*")
    return across.where((F.col("d") + F.col("e") <= reach * reach) & F.col("x").between(0, width - 1)).select("y", "x").distinct()


def edit_classes(base: DataFrame, edited: DataFrame, height: int, width: int, reach: int = 16) -> DataFrame:
    """``(y, x, class)`` of all pixels near an edit, as the edited labels ``(y, x, label)`` have them; a boundary comes before its nucleus. Equal labels give no row."""
    near = within(difference(base, edited), reach, height, width)
    # What decides the boundary of a pixel within reach lies within reach + 1.
    around = edited.join(by_sort(within(difference(base, edited), reach + 1, height, width)), ["y", "x"], "left_semi").where("label > 0")
    edge = inner_boundary(around, height, width).select("y", "x", F.lit(2).alias("edge"))
    own = around.select("y", "x", F.lit(1).alias("own"))
    return near.join(by_sort(own), ["y", "x"], "left").join(by_sort(edge), ["y", "x"], "left").select("y", "x", F.coalesce("edge", "own", F.lit(3)).alias("class"))


def training_pixels(classes: DataFrame, budget: int = 200_000) -> DataFrame:
    """A third of ``budget`` of each class, by a hash of the place; a class that has fewer gives all, and the others do not take its share."""
    return sample_by_class(classes, "class", max(1, budget // CLASSES), "y", "x")


def store_vectors(store: FeatureStore, image: str, recipe: Recipe, channels: list[int]) -> DataFrame:
    """``(ty, tx, y, x, features)`` of the tiles that have all channels and scales in the store: a join of tiles by their place, then one pass to pixels."""
    tiles, names = None, []
    for c in channels:
        for sigma in recipe.sigmas:
            names.append(f"d{len(names)}")
            one = store.read(image, recipe, c, sigma).withColumnRenamed("data", names[-1])
            tiles = one if tiles is None else tiles.join(one.drop("h", "w"), ["ty", "tx"])
    schema = pa.schema([("ty", pa.int64()), ("tx", pa.int64()), ("y", pa.int64()), ("x", pa.int64()), ("f", pa.list_(pa.float64()))])
    size = recipe.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w = r["h"], r["w"]
                stack = np.concatenate([np.frombuffer(r[n], "<f2").reshape(len(MAPS), h * w) for n in names]).T.astype(float)
                y, x = np.divmod(np.arange(h * w), w)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1) * stack.shape[1], pa.int32()), pa.array(stack.ravel()))
                same = lambda v: pa.array(np.full(h * w, v))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(r["ty"]), same(r["tx"]), pa.array(y + r["ty"] * size), pa.array(x + r["tx"] * size), lists], schema=schema)

    return tiles.mapInArrow(run, "ty long, tx long, y long, x long, f array<double>").select("ty", "tx", "y", "x", array_to_vector("f").alias("features"))


@dataclass
class Propagated:
    """A forest, the pixels that it was fitted on, and the record that is kept with it."""

    model: RandomForestClassificationModel
    sample: DataFrame
    record: dict


def fit_edits(vectors: DataFrame, base: DataFrame, edited: DataFrame, height: int, width: int, reach: int = 16, budget: int = 200_000, trees: int = 200, seed: int = 0) -> Propagated:
    """A forest of ``vectors`` ``(y, x, features)`` at the training pixels of an edit; labels that do not differ are an error."""
    steps = Steps(vectors.sparkSession, "edits", keep_all=True)  # what is read more than once, ``budget`` rows
    sample = steps.save(training_pixels(edit_classes(base, edited, height, width, reach), budget))
    counts = {r["class"]: r["n"] for r in sample.groupBy("class").agg(F.count("*").alias("n")).collect()}  # three rows
    if not counts:
        raise ValueError("no label was edited")
    rows = vectors.join(F.broadcast(sample), ["y", "x"]).select("features", (F.col("class") - 1).cast("int").alias("label"))
    model = train_forest(steps.save(rows), "features", "label", trees, seed)
    return Propagated(model, sample, {"kind": "edits", "reach": reach, "budget": budget, "trees": trees, "seed": seed, "pixels": {str(k): counts[k] for k in sorted(counts)}})


def held_out_score(told: Propagated, vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """``(class, n, right)`` of pixels near the edit that the forest was not fitted on."""
    rest = classes.join(told.sample.select("y", "x"), ["y", "x"], "left_anti")
    p = predict(told.model, vectors.join(by_sort(rest), ["y", "x"]), ["class"], CLASSES)
    best = F.greatest("p0", "p1", "p2")
    guess = F.when(F.col("p0") == best, 1).when(F.col("p1") == best, 2).otherwise(3)
    return p.groupBy("class").agg(F.count("*").alias("n"), F.count(F.when(guess == F.col("class"), 1)).alias("right"))


def predict_by_focus(model, vectors: DataFrame, size: int, focus: tuple[float, float]) -> DataFrame:
    """``(d2, ty, tx, y, x, p0, p1, p2)`` of pixels ``(ty, tx, y, x, features)``: ``d2`` is the squared distance of the tile's centre to the focus, by which partitions are ordered, so that the first tasks have the nearest tiles."""
    cy, cx = (F.col("ty") + 0.5) * size - focus[0], (F.col("tx") + 0.5) * size - focus[1]
    return predict(model, vectors.withColumn("d2", cy * cy + cx * cx), ["d2", "ty", "tx", "y", "x"], CLASSES).repartitionByRange("d2", "ty", "tx")


def save_model(told: Propagated, path: str, spark: SparkSession, **more) -> None:
    """The forest, and then its record, which alone makes it count: a save that was interrupted has none."""
    told.model.write().overwrite().save(f"{path}/forest")
    save_manifest(spark, f"{path}/record.json", json.loads(json.dumps(told.record | more)))


def load_model(spark: SparkSession, path: str) -> tuple[RandomForestClassificationModel, dict]:
    record = load_manifest(spark, f"{path}/record.json")
    if record is None:
        raise FileNotFoundError(f"{path} has no finished model")
    return RandomForestClassificationModel.load(f"{path}/forest"), record
