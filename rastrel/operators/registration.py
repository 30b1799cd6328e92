"""Warping and shift estimation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def warp(px: DataFrame, field: DataFrame) -> DataFrame:
    """Inverse warp ``out[y, x] = in[y - dy, x - dx]``, bilinear, 0 outside, as one equal join.

    Each output pixel asks for its four source pixels; source and requests meet
    by hash of the source place, whatever the field, and the weighted parts are
    summed on the way back.
    """
    sy, sx = F.col("y") - F.col("dy"), F.col("x") - F.col("dx")
    iy, ix = F.floor(sy), F.floor(sx)
    fy, fx = sy - iy, sx - ix
    reads = [F.struct((iy + a).alias("sy"), (ix + b).alias("sx"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)]
    asked = field.select("y", "x", F.explode(F.array(*reads)).alias("r")).select("y", "x", "r.*").where("w > 0")
    source = px.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    met = asked.join(source, ["sy", "sx"]).groupBy("y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return field.select("y", "x").join(met, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def whitened_peak(cross: np.ndarray, floor: float = 1e-12) -> tuple[float, float]:
    """The peak of the correlation whose cross spectrum is given, refined by a parabola; frequencies weigh the same, but less if their power is below ``floor``."""
    surface = np.fft.ifft2(cross / np.maximum(np.abs(cross), floor)).real
    peak = np.unravel_index(int(surface.argmax()), surface.shape)
    out = []
    for axis, (p, n) in enumerate(zip(peak, surface.shape)):
        at = lambda k: surface[tuple((p + k) % n if a == axis else q for a, q in enumerate(peak))]  # noqa: B023, E731
        bend = at(-1) - 2 * at(0) + at(1)
        part = 0.5 * (at(-1) - at(1)) / bend if abs(bend) > 1e-12 else 0.0
        out.append(float(p - n if p > n // 2 else p) + float(np.clip(part, -0.5, 0.5)))
    return out[0], out[1]


def phase_shift(fixed: np.ndarray, moving: np.ndarray) -> tuple[float, float]:
    """The shift that brings ``moving`` onto ``fixed``: the peak of the phase correlation."""
    return whitened_peak(np.fft.fft2(fixed) * np.conj(np.fft.fft2(moving)))


def estimate_shifts(fixed: DataFrame, moving: DataFrame, key: list[str], tile: int) -> DataFrame:
    """``(key, ty, tx, dy, dx)`` of each tile: tiles are the groups, so a group never outgrows one tile."""
    place = [*key, F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx"), F.expr(f"cast(y % {tile} as int)").alias("yy"), F.expr(f"cast(x % {tile} as int)").alias("xx")]
    both = fixed.select(*place, F.col("v").cast("double").alias("a"), F.lit(0.0).alias("b")).unionByName(moving.select(*place, F.lit(0.0).alias("a"), F.col("v").cast("double").alias("b")))
    kinds = dict(both.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*key, "ty", "tx"]) + ", dy double, dx double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((tile, tile)), np.zeros((tile, tile))
        np.add.at(a, (group["yy"].to_numpy(), group["xx"].to_numpy()), group["a"].to_numpy())
        np.add.at(b, (group["yy"].to_numpy(), group["xx"].to_numpy()), group["b"].to_numpy())
        dy, dx = phase_shift(a - a.mean(), b - b.mean())
        head = group[[*key, "ty", "tx"]].head(1).reset_index(drop=True)
        return head.assign(dy=dy, dx=dx)

    return both.groupBy(*key, "ty", "tx").applyInPandas(run, schema)
