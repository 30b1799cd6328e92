"""One shift for a whole slide, and images moved by it, on tiles ``(y0, x0, h, w, dtype, px)``.

Fields follow ``out[y, x] = in[y - dy, x - dx]``, as in ``elastic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elastic import PIECE, TILE, _dealt, _plane, _roles, _schema, sample
from .registration import whitened_peak

SPECTRUM = "cross binary"
#: Tasks that add up the spectra of all others before the last one.
FOLDS = 16
#: Frequencies below this part of the strongest one's power are noise as likely as image.
QUIET = 1e-3
MOVED = f"channel int, {TILE}"


def block_means(block: np.ndarray, d: int) -> np.ndarray:
    """Means of blocks of ``d`` by ``d``, of what there is at the lower and right edge."""
    rows, columns = (np.arange(0, n, d) for n in block.shape)
    total = np.add.reduceat(np.add.reduceat(block.astype(float), rows, 0), columns, 1)
    return total / np.outer(*(np.minimum(d, n - at) for n, at in zip(block.shape, (rows, columns))))


def shrunk(tiles: DataFrame, d: int) -> DataFrame:
    """Tiles of block means; their origins have to be multiples of ``d``, so that no block lies in two tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["y0"] % d or r["x0"] % d:
                    raise ValueError(f"tile at {r['y0']}, {r['x0']} does not begin at a block of {d}")
                small = block_means(np.frombuffer(r["px"], np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["h"], r["w"]), d).astype("<f4")
                rows.append({"y0": r["y0"] // d, "x0": r["x0"] // d, "h": small.shape[0], "w": small.shape[1], "dtype": "float32", "px": small.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _schema(TILE))

    return tiles.select(*[c.split()[0] for c in TILE.split(", ")]).mapInArrow(run, TILE)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all spectra of a task, one row; nothing if it has none."""
    total = None
    for batch in batches:
        for raw in batch.column(0):
            one = np.frombuffer(raw.as_buffer(), "<c16")
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_pylist([{"cross": total.tobytes()}], _schema(SPECTRUM))


def _centred(rows: list[dict], role: int, side: int) -> np.ndarray:
    """The plane less its mean where there are pixels, 0 elsewhere; it fades towards the tile's edges, which would else agree at no shift."""
    plane = _plane(rows, role, side, np.nan)
    there = np.isfinite(plane)
    fade = np.sin(np.pi * (np.arange(side) + 0.5) / side) ** 2
    return np.where(there, plane - plane[there].mean(), 0.0) * np.outer(fade, fade) if there.any() else np.zeros((side, side))


def summed_shift(fixed: DataFrame, moving: DataFrame, height: int, width: int, size: int) -> tuple[float, float]:
    """The shift of most agreement over all tiles of ``size`` pixels, within half a tile; (0, 0) where no tile has contrast.

    Each tile gives the cross spectrum of its two planes.  Spectra have one size
    whatever the image, and are added in the task that made them, then in
    ``FOLDS`` tasks, then in one: a task holds one sum, never the image.
    """
    cells = (-(-height // size), -(-width // size))

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        a, b = _centred(rows, 0, size), _centred(rows, 1, size)
        return pa.Table.from_pylist([{"cross": (np.fft.fft2(a) * np.conj(np.fft.fft2(b))).astype("<c16").tobytes()}], _schema(SPECTRUM))

    pieces = _roles(fixed=fixed, moving=moving).mapInArrow(_dealt(size, size, 0, cells, (0, 1)), PIECE)
    sums = pieces.groupBy("ty", "tx").applyInArrow(one, SPECTRUM).mapInArrow(_added, SPECTRUM)
    last = sums.repartition(FOLDS).mapInArrow(_added, SPECTRUM).repartition(1).mapInArrow(_added, SPECTRUM).first()
    cross = np.frombuffer(last["cross"], "<c16").reshape(size, size) if last else np.zeros((size, size))
    most = np.abs(cross).max()
    return whitened_peak(cross, QUIET * most) if most > 1e-9 else (0.0, 0.0)


def slide_shift(fixed: DataFrame, moving: DataFrame, height: int, width: int, size: int = 512, coarse: int = 8, steps: int = 10) -> tuple[float, float]:
    """The shift of a slide to one ``steps``-th of a pixel: on block means of ``coarse`` pixels first, then at full size from there.

    Reaches half of ``size * coarse`` pixels.
    """
    dy = dx = 0
    if coarse > 1:
        dy, dx = (round(d * coarse) for d in summed_shift(shrunk(fixed, coarse), shrunk(moving, coarse), -(-height // coarse), -(-width // coarse), size))
    near = moving.withColumn("y0", F.col("y0") + dy).withColumn("x0", F.col("x0") + dx)
    fy, fx = summed_shift(fixed, near, height, width, size)
    return round((dy + fy) * steps) / steps, round((dx + fx) * steps) / steps


def as_type(plane: np.ndarray, dtype: str) -> np.ndarray:
    """Whole types are rounded to the even one and held within their limits."""
    kind = np.dtype(dtype)
    if kind.kind in "ui":
        plane = np.clip(np.rint(plane), np.iinfo(kind).min, np.iinfo(kind).max)
    return plane.astype(kind.newbyteorder("<"))


def moved(tiles: DataFrame, dy: float, dx: float, height: int, width: int, size: int, dtype: str) -> DataFrame:
    """``MOVED`` tiles of ``size`` pixels of a canvas, from tiles ``(channel, y0, x0, h, w, dtype, px)`` read through one shift; 0 outside the image.

    The whole part of the shift moves origins and costs nothing; only a fraction
    is interpolated, with a halo of one pixel.  A group is one tile of one channel.
    Values are float32 on the way: whole numbers are exact up to 2^24.
    """
    cells = (-(-height // size), -(-width // size))
    whole = (int(np.floor(dy)), int(np.floor(dx)))
    fy, fx = dy - whole[0], dx - whole[1]
    side = size + 2

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        c, ty, tx = (rows[0][k] for k in ("role", "ty", "tx"))
        y, x = np.mgrid[0:size, 0:size] + 1
        got = as_type(sample(_plane(rows, c, side), y - fy, x - fx)[: height - ty * size, : width - tx * size], dtype)
        return pa.Table.from_pylist([{"channel": c, "y0": ty * size, "x0": tx * size, "h": got.shape[0], "w": got.shape[1], "dtype": dtype, "px": got.tobytes()}], _schema(MOVED))

    own = tiles.select(F.col("channel").cast("int").alias("role"), (F.col("y0") + whole[0]).alias("y0"), (F.col("x0") + whole[1]).alias("x0"), "h", "w", "dtype", "px")
    return own.mapInArrow(_dealt(size, size, 1, cells, ()), PIECE).groupBy("role", "ty", "tx").applyInArrow(one, MOVED)
