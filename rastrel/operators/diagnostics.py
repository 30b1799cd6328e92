"""Report on a touch-up: how far tiles would still move under several bounds, what is wrong with each, seams, heat maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import touchup as T

# The bound that the touch-up uses, what a wider one must gain on it, and the jump and the drop in correlation of a suspect seam.
PIVOT, BEYOND, JUMP, DROP = 128, 0.05, 64.0, 0.15


def bound_sweep(pairs: DataFrame, size: int, bounds: list[int], halo: int = 0) -> DataFrame:
    """``(tile, bound, dy, dx, mag, base, corr, gain, hit)`` of tiles ``(tile, y, x, a, b, m)``: the best shift within each bound.

    All shifts of a tile are scored once, up to the widest bound; a narrower one
    looks at the middle of that surface.  Scores have six decimals; ``hit``: the
    shift lies on its bound.  Tiles with a mask of fewer than 32 pixels have no
    rows.  A group is one tile and its halo.
    """
    schema = "tile long, bound long, dy long, dx long, mag double, base double, corr double, gain double, hit boolean"
    side, widest = size + 2 * halo, max(bounds)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = group["y"].to_numpy() + halo, group["x"].to_numpy() + halo
        a, b, use = np.full((side, side), np.nan), np.full((side, side), np.nan), np.zeros((side, side), bool)
        a[at], b[at], use[at] = group["a"].to_numpy(float), group["b"].to_numpy(float), group["m"].to_numpy(bool)
        use &= ~np.isnan(a)
        rows = []
        if use.sum() >= T.LEAST_MASK:
            surface = T.score_surface(*(T.stretched(np.nan_to_num(p), ~np.isnan(p)) for p in (a, b)), use, widest)
            for bound in bounds:
                cut = slice(widest - bound, widest + bound + 1)
                dy, dx, base, best = T.best_shift(surface[cut, cut])
                base, best = round(base, 6), round(best, 6)
                rows.append((int(group["tile"].iloc[0]), bound, dy, dx, round(float(np.hypot(dy, dx)), 6), base, best, round(best - base, 6), max(abs(dy), abs(dx)) == bound))
        return pd.DataFrame(rows, columns=["tile", "bound", "dy", "dx", "mag", "base", "corr", "gain", "hit"])

    return pairs.groupBy("tile").applyInPandas(run, schema)


def diagnose(sweep: DataFrame, final: DataFrame, skip: float = 0.95, pivot: int = PIVOT) -> DataFrame:
    """One row for each tile of a sweep: its best bound and shift, and what that says about the result.

    ``final``: ``(tile, final)``, the correlation in the merged image, null or
    missing if there is none.  The best bound is that of the highest correlation,
    the narrowest of equal ones.  One aggregation and one join by tile.
    """
    best = F.max_by(F.struct("bound", "dy", "dx", "mag", "corr", "gain"), F.struct(F.col("corr"), -F.col("bound"))).alias("t")
    at = F.col("bound") == pivot
    tiles = sweep.groupBy("tile").agg(best, F.first("base").alias("base"), F.coalesce(F.max(F.when(at, F.col("hit"))), F.lit(False)).alias("hit"), F.max(F.when(at, F.col("corr"))).alias("pivot"))
    rows = tiles.join(final.select("tile", "final"), "tile", "left").select("tile", "t.*", "base", "final", "hit", F.coalesce((F.col("t.bound") > pivot) & (F.col("t.corr") >= F.col("pivot") + BEYOND), F.lit(False)).alias("beyond"), (F.col("base") >= skip).alias("skipped"))
    # The five classes, by the first rule that fits.
    kind = (
        F.when(F.col("final") >= 0.8, "well_registered")
        .when(F.col("hit") | F.col("beyond"), "rigid_bound_limited")
        .when(F.col("skipped") & (F.col("final") < 0.6), "skipped_incorrectly_suspect")
        .when(F.col("corr") < F.col("base") + 0.05, "upstream_rigid_or_low_texture_suspect")
        .otherwise("elastic_or_blending_suspect")
    )
    return rows.withColumn("kind", kind)


def suspect_seams(tiles: DataFrame, stride: int, jump: float = JUMP, drop: float = DROP) -> DataFrame:
    """``(tile, side, jump, delta, suspect)`` of diagnosed tiles with their places ``(y0, x0)``: how shift and final correlation change to the right and lower neighbour."""
    other = tiles.select(F.col("y0").alias("ny"), F.col("x0").alias("nx"), F.col("dy").alias("oy"), F.col("dx").alias("ox"), F.col("final").alias("of"))
    to = [F.struct(F.lit(s).alias("side"), (F.col("y0") + dy).alias("ny"), (F.col("x0") + dx).alias("nx")) for s, dy, dx in (("right", 0, stride), ("down", stride, 0))]
    met = tiles.select("tile", "dy", "dx", "final", F.explode(F.array(*to)).alias("s")).select("tile", "dy", "dx", "final", "s.*").join(other, ["ny", "nx"])
    rows = met.select("tile", "side", F.round(F.hypot(F.col("dy") - F.col("oy"), F.col("dx") - F.col("ox")), 6).alias("jump"), F.round(F.abs(F.col("final") - F.col("of")), 6).alias("delta"))
    return rows.withColumn("suspect", (F.col("jump") >= jump) & F.coalesce(F.col("delta") >= drop, F.lit(True)))


def worst_first(tiles: DataFrame, n: int) -> DataFrame:
    """The ``n`` tiles to look at first: those that a bound limits, then by what is to gain, then by distance, then by number."""
    gain = F.coalesce(F.col("corr") - F.col("final"), F.col("gain"))
    return tiles.orderBy(F.col("kind") != "rigid_bound_limited", F.round(gain, 6).desc(), F.col("mag").desc(), "tile").limit(n)


def heat_map(tiles: DataFrame, height: int, width: int, stride: int) -> DataFrame:
    """``(y, x, red, green, blue)`` for each cell of ``stride`` pixels of the canvas: distance, gain and bound of its tile, 0 to 255.

    Each band runs from its 1st to its 99.5th percentile over all cells; cells
    without a tile are 0, and of several tiles in a cell the largest values count.
    """
    rows, columns = -(-height // stride), -(-width // stride)
    cell = lambda c, n: F.least(F.expr(f"{c} div {stride}"), F.lit(n - 1)).cast("long").alias(c[0])
    held = tiles.select(cell("y0", rows), cell("x0", columns), "mag", "gain", "bound").groupBy("y", "x").agg(F.max("mag").alias("red"), F.greatest(F.max("gain"), F.lit(0.0)).alias("green"), F.max("bound").cast("double").alias("blue"))
    bands = ("red", "green", "blue")
    every = tiles.sparkSession.range(rows * columns).select(F.expr(f"id div {columns}").alias("y"), F.expr(f"id % {columns}").alias("x")).join(held, ["y", "x"], "left").fillna(0.0, list(bands))
    limits = every.agg(*[F.percentile(b, F.lit(p)).alias(f"{b}_{k}") for b in bands for k, p in (("low", 0.01), ("high", 0.995))])  # one row
    met = every.crossJoin(F.broadcast(limits))

    def band(b: str):
        low, high = F.col(f"{b}_low"), F.col(f"{b}_high")
        share = (F.col(b) - low) / F.when(high > low, high - low).otherwise(1.0)
        return F.rint(F.least(F.greatest(F.round(share, 9), F.lit(0.0)), F.lit(1.0)) * 255).cast("long").alias(b)

    return met.select("y", "x", *map(band, bands))


def summary(tiles: DataFrame, seams: DataFrame) -> DataFrame:
    """``(what, n)``: tiles of each class, all tiles, pairs and suspect pairs; counts combine before they are shuffled."""
    kinds = tiles.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    totals = [tiles.agg(F.count("*").alias("n")).select(F.lit("tiles").alias("what"), "n"), seams.agg(F.count("*").alias("n")).select(F.lit("pairs").alias("what"), "n"), seams.agg(F.count_if("suspect").alias("n")).select(F.lit("suspect pairs").alias("what"), "n")]
    for t in totals:
        kinds = kinds.unionByName(t)
    return kinds
