"""Pixel classification with the library's own random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import by_sort
from ..functions.scalars import symmetric_eigenvalues
from .neighbourhood import gaussian, gaussian_derivatives, structure_tensor


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Rows with the weight n / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(counts), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def train_forest(rows: DataFrame, features: str, label: str, trees: int = 200, seed: int = 0, depth: int = 8):
    return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(balanced(rows, label))


def predict(model, rows: DataFrame, keep: list[str], classes: int) -> DataFrame:
    """Class probabilities by column; a class that the model never saw has probability 0."""
    p = vector_to_array("probability")
    return model.transform(rows).select(*keep, *[F.round(F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)), 9).alias(f"p{k}") for k in range(classes)])


def classify_vectors(rows: DataFrame, key: str, array: str, label: str, classes: int, trees: int = 20) -> DataFrame:
    vectors = rows.select(key, F.col(label).cast("int").alias("label"), array_to_vector(F.col(array).cast("array<double>")).alias("features"))
    return predict(train_forest(vectors.where("label is not null"), "features", "label", trees), vectors, [key], classes)


def feature_stack(px: DataFrame, sigmas: list[float], height: int, width: int) -> DataFrame:
    """The pixel and eight maps by scale, in this order.

    Smoothed value, gradient magnitude, Laplacian of the Gaussian, difference of
    Gaussians (ratio 1.6), larger and smaller eigenvalue of the structure tensor
    and of the Hessian.
    """
    out = px.select("y", "x", F.col("v").cast("double").alias("raw"))
    for k, s in enumerate(sigmas):
        fine = gaussian_derivatives(px, s, height, width)
        wide = gaussian(px, s * 1.6, height, width).withColumnRenamed("v", "_wide")
        s1, s2 = symmetric_eigenvalues(F.col("ayy"), F.col("ayx"), F.col("axx"))
        h1, h2 = symmetric_eigenvalues(F.col("hyy"), F.col("hyx"), F.col("hxx"))
        maps = fine.join(by_sort(wide), ["y", "x"]).join(by_sort(structure_tensor(px, s, height, width)), ["y", "x"]).select(
            "y", "x", F.col("v").alias(f"g{k}"), F.hypot("gy", "gx").alias(f"grad{k}"), (F.col("hyy") + F.col("hxx")).alias(f"log{k}"), (F.col("v") - F.col("_wide")).alias(f"dog{k}"),
            s1.alias(f"st_big{k}"), s2.alias(f"st_small{k}"), h1.alias(f"he_big{k}"), h2.alias(f"he_small{k}"),
        )
        out = out.join(by_sort(maps), ["y", "x"])
    return out


def classify_pixels(features: DataFrame, scribbles: DataFrame, classes: int = 3, trees: int = 20) -> DataFrame:
    """Probabilities of every pixel from a forest fitted on the scribbled ones."""
    names = [c for c in features.columns if c not in ("y", "x")]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(features)
    marked = rows.join(by_sort(scribbles), ["y", "x"]).select("features", (F.col("class") - 1).cast("int").alias("label"))
    return predict(train_forest(marked, "features", "label", trees), rows, ["y", "x"], classes)
