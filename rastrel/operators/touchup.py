"""Touch-up of a registration: bounded shifts of tiles and regions, and the gates that accept them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates as A

# Least gain and correlation of a correction, least pixels of signal of a tile, least pixels of a score mask.
LEAST_GAIN, LEAST_CORR, LEAST_SIGNAL, LEAST_MASK = 0.01, 0.5, 1024, 32


def score_mask(px: DataFrame, by: list[str], mask: str = "m", least: int = LEAST_MASK) -> DataFrame:
    """Pixels that score a tile: those of its mask, or all if the mask has fewer than ``least``."""
    held = px.groupBy(*by).agg(F.count_if(F.col(mask)).alias("_held"))
    return px.join(held, by).where(F.col(mask) | (F.col("_held") < least)).drop("_held")


def signal_pixels(island: DataFrame, foreground: DataFrame, tile: int) -> DataFrame:
    """``(tile_y, tile_x, n, trusted)``: foreground pixels of an island in each tile, and whether they are enough to vote."""
    met = island.select("y", "x").join(foreground.select("y", "x"), ["y", "x"], "left_semi")
    rows = met.groupBy(F.expr(f"y div {tile}").alias("tile_y"), F.expr(f"x div {tile}").alias("tile_x")).agg(F.count("*").alias("n"))
    return rows.withColumn("trusted", F.col("n") >= LEAST_SIGNAL)


def gate(base: Column, corr: Column, signal: Column, skip: float = 0.95) -> Column:
    """What becomes of a tile's correction: ``abstain`` without signal, ``stable`` where nothing needs doing, else accepted or rejected by gain and correlation."""
    good = (corr - base >= LEAST_GAIN) & (corr >= LEAST_CORR)
    return F.when(signal < LEAST_SIGNAL, "abstain").when(base >= skip, "stable").when(corr.isNull() | F.isnan(corr), "rejected").when(good, "accepted").otherwise("rejected")


def score_surface(fixed: np.ndarray, moving: np.ndarray, use: np.ndarray, bound: int) -> np.ndarray:
    """``[dy + bound, dx + bound]``: the correlation of ``fixed`` with ``moving`` shifted by ``(dy, dx)``, over the pixels of ``use``.

    Sums under the mask are correlations of planes, so three products of spectra
    give all shifts at once.  What comes in from outside is 0; a shift without
    contrast scores 0.
    """
    shape = [n + bound for n in fixed.shape]
    spectrum = lambda plane: np.fft.rfft2(plane, shape)
    n, own = use.sum(), np.where(use, fixed - fixed[use].mean(), 0.0)
    mask, shifted = spectrum(use.astype(float)), np.conj(spectrum(moving))
    sums, squares, cross = (np.fft.irfft2(x, shape) for x in (mask * shifted, mask * np.conj(spectrum(moving * moving)), spectrum(own) * shifted))
    power = (own * own).sum() * (squares - sums * sums / n)
    score = np.where(power > 1e-9, cross / np.sqrt(np.maximum(power, 1e-9)), 0.0)
    lags = np.arange(-bound, bound + 1)
    return score[np.ix_(lags, lags)]


def best_shift(surface: np.ndarray) -> tuple[int, int, float, float]:
    """``(dy, dx, base, best)``: the highest score, to nine decimals, then the nearest shift, then the smallest ``(dy, dx)``; none below a gain of 1e-6."""
    bound = len(surface) // 2
    dy, dx = np.mgrid[-bound : bound + 1, -bound : bound + 1]
    first = np.lexsort((dx.ravel(), dy.ravel(), (dy * dy + dx * dx).ravel(), -np.round(surface, 9).ravel()))[0]
    base, best = float(surface[bound, bound]), float(surface.ravel()[first])
    return (int(dy.ravel()[first]), int(dx.ravel()[first]), base, best) if best > base + 1e-6 else (0, 0, base, base)


def stretched(plane: np.ndarray, held: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """0 to 1 between the 1st and 99th percentile of the pixels held, or of those of ``by``, clipped; pixels not held, and planes without contrast, are 0."""
    own = plane[held if by is None else by]
    low, high = np.percentile(own, (1, 99)) if len(own) else (0.0, 0.0)
    return np.where(held, np.clip((plane - low) / (high - low), 0, 1), 0.0) if high > low else np.zeros_like(plane)


def rigid_touchup(pairs: DataFrame, size: int, bound: int, least_gain: float = LEAST_GAIN, least_corr: float = LEAST_CORR, halo: int = 0) -> DataFrame:
    """``(tile, dy, dx, base, corr, accepted)`` of tiles ``(tile, y, x, a, b, m)``: fixed and moving values and the mask.

    The shift of ``b`` within ``bound`` that correlates best with ``a`` under the
    mask, both stretched from their 1st to their 99th percentile; every shift is
    scored.  Moving pixels may reach ``halo`` beyond the tile on all sides; there
    ``a`` is null and the mask false, so what is shifted in is the neighbour's and
    not 0.  A group is one tile of at most ``size`` squared pixels and its halo.
    Rejected tiles have no shift; a mask of fewer than 32 pixels gives none either.
    """
    schema = "tile long, dy double, dx double, base double, corr double, accepted boolean"
    side = size + 2 * halo

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = group["y"].to_numpy() + halo, group["x"].to_numpy() + halo
        a, b = np.full((side, side), np.nan), np.full((side, side), np.nan)
        use = np.zeros((side, side), bool)
        a[at], b[at], use[at] = group["a"].to_numpy(float), group["b"].to_numpy(float), group["m"].to_numpy(bool)
        use &= ~np.isnan(a)
        dy = dx = 0
        base = best = 0.0
        if use.sum() >= LEAST_MASK:
            fixed, moving = (stretched(np.nan_to_num(p), ~np.isnan(p)) for p in (a, b))
            dy, dx, base, best = best_shift(score_surface(fixed, moving, use, bound))
        ok = (dy, dx) != (0, 0) and best - base >= least_gain and best >= least_corr
        return pd.DataFrame({"tile": [group["tile"].iloc[0]], "dy": [float(dy * ok)], "dx": [float(dx * ok)], "base": [base], "corr": [best], "accepted": [ok]})

    return pairs.groupBy("tile").applyInPandas(run, schema)


def refine_regions(fixed: DataFrame, moving: DataFrame, radius: int, height: int, width: int, penalty: float = 0.0) -> DataFrame:
    """``(region, dy, dx, base, corr)``: the best residual shift of each region of ``fixed(region, y, x, v)``.

    Regions below ``max(32, radius squared)`` pixels keep no shift; others take the
    shift of the highest correlation, less ``penalty`` for each pixel of distance,
    if it beats the present one by 1e-6.  All shifts are tried in one equal join.
    """
    shifts = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)])
    source = moving.select("y", "x", F.col("v").alias("b"), F.explode(shifts).alias("s")).select((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "b", "s.dy", "s.dx")
    scored = A.correlation(fixed.withColumnRenamed("v", "a").join(source, ["y", "x"]), [F.col("region"), F.col("dy"), F.col("dx")], 1)
    scored = scored.withColumn("corr", F.round(F.coalesce("corr", F.lit(0.0)), 9)).withColumn("cost", F.round(F.col("corr") - penalty * F.hypot("dy", "dx"), 9))
    far = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    best = scored.groupBy("region").agg(F.max_by(F.struct("dy", "dx", "corr", "cost"), F.struct(F.col("cost"), -far, -F.col("dy"), -F.col("dx"))).alias("t"), F.max(F.when(far == 0, F.col("corr"))).alias("base"))
    sizes = fixed.groupBy("region").agg(F.count("*").alias("n"))
    ok = (F.col("n") >= max(32, radius * radius)) & (F.col("t.cost") > F.coalesce("base", F.lit(0.0)) + 1e-6)
    return sizes.join(best, "region", "left").select("region", *[F.when(ok, F.col(f"t.{c}")).otherwise(0).cast("long").alias(c) for c in ("dy", "dx")], F.coalesce("base", F.lit(0.0)).alias("base"), F.when(ok, F.col("t.corr")).otherwise(F.coalesce("base", F.lit(0.0))).alias("corr"))


def field_preview(parts: DataFrame, block: int) -> DataFrame:
    """``(y, x, dy, dx, mag, log_w)`` of blocks of weighted fields ``(y, x, dy, dx, w)``: mean shift, its length, and the logarithm of the weight."""
    sums = parts.groupBy(F.expr(f"y div {block}").alias("y"), F.expr(f"x div {block}").alias("x")).agg(F.sum("w").alias("w"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("dy", "dx")]).where("w > 1e-5")
    mean = sums.select("y", "x", (F.col("dy") / F.col("w")).alias("dy"), (F.col("dx") / F.col("w")).alias("dx"), "w")
    return mean.select("y", "x", (F.round("dy", 9) + 0.0).alias("dy"), (F.round("dx", 9) + 0.0).alias("dx"), F.round(F.hypot("dy", "dx"), 9).alias("mag"), F.round(F.log10("w"), 9).alias("log_w"))


def crop(px: DataFrame, box: tuple[int, int, int, int], dy: float, dx: float) -> DataFrame:
    """``(y, x, v)`` of the box ``(y0, y1, x0, x1)`` of a plane shifted by ``(dy, dx)``, bilinear, 0 outside.

    Source rows outside the box and its margin of one pixel are filtered in the
    scan; each spreads to the places whose value it bears on, and parts are summed.
    """
    y0, y1, x0, x1 = box
    iy, ix = math.floor(dy), math.floor(dx)
    fy, fx = dy - iy, dx - ix
    near = px.where(F.col("y").between(y0 - iy - 1, y1 - iy - 1) & F.col("x").between(x0 - ix - 1, x1 - ix - 1))
    parts = [(iy + a, ix + b, (fy if a else 1 - fy) * (fx if b else 1 - fx)) for a in (0, 1) for b in (0, 1)]
    to = F.explode(F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), F.lit(float(w)).alias("w")) for a, b, w in parts if w > 0]))
    got = near.select("v", to.alias("p")).select("p.*", "v").groupBy("y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    every = px.sparkSession.range(y0, y1).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(x0).cast("long"), F.lit(x1 - 1).cast("long"))).alias("x"))
    return every.join(got, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
