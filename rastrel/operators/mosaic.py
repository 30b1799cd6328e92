"""Stitching: tile pixels meet on the canvas and are blended by feathered weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tent


def feathered_mosaic(tiles: DataFrame, positions: DataFrame, h: int, w: int, truncate: bool = True) -> DataFrame:
    """``(y, x, v)`` from tile pixels ``(tile, y, x, v)`` and ``(tile, py, px)``.

    Positions are few and joined to pixels as Spark sees fit; the blend is one
    aggregation on the canvas place.  Written mosaics truncate, others round.
    """
    weight = (tent(F.col("y"), F.lit(h)) * tent(F.col("x"), F.lit(w))).cast("double") / float(((h + 1) // 2) * ((w + 1) // 2))
    placed = tiles.join(positions, "tile").select((F.col("y") + F.col("py")).alias("y"), (F.col("x") + F.col("px")).alias("x"), "v", weight.alias("w"))
    mean = F.sum(F.col("v") * F.col("w")) / F.sum("w")
    out = placed.groupBy("y", "x").agg(F.round(mean, 6).alias("m"))
    return out.select("y", "x", (F.floor("m") if truncate else F.rint("m")).cast("long").alias("v"))


def neighbour_pairs(acq: DataFrame) -> DataFrame:
    """``(axis, src, dst)``: tiles with a right or lower neighbour, by an equal join on the grid place."""
    sides = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("gy").alias("ny"), (F.col("gx") + 1).alias("nx")), F.struct(F.lit("y").alias("axis"), (F.col("gy") + 1).alias("ny"), F.col("gx").alias("nx"))))
    asked = acq.select(F.col("tile").alias("src"), sides.alias("s")).select("src", "s.*")
    return asked.join(acq.select(F.col("tile").alias("dst"), F.col("gy").alias("ny"), F.col("gx").alias("nx")), ["ny", "nx"]).select("axis", "src", "dst")


def nominal_steps(edges: DataFrame) -> DataFrame:
    """Median shift of each axis over trusted edges; over all edges where there are none."""
    med = lambda c, ok: F.percentile(F.when(ok, F.col(c)), F.lit(0.5))
    good = ~F.col("fallback")
    return edges.groupBy("axis").agg(F.coalesce(med("dy", good), med("dy", F.lit(True))).alias("dy"), F.coalesce(med("dx", good), med("dx", F.lit(True))).alias("dx"))


def first_per_place(files: DataFrame) -> DataFrame:
    """One file for each grid place: the first by path."""
    return files.groupBy("gy", "gx").agg(F.min("path").alias("path"))
