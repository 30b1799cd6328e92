"""Elastic touch-up of a registration on tiles with halos.

An image is a table of tiles ``(y0, x0, h, w, dtype, px)`` as the TIFF source
gives them.  Tiles hand pieces to the cells of an overlapping lattice, so what is
shuffled grows with the tiles; a cell of fixed size is registered in one task by
a named kernel, and its field goes back in pieces to output tiles, where weighted
fields are summed.  Fields follow ``out[y, x] = in[y - dy, x - dx]``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .touchup import LEAST_CORR, LEAST_GAIN, LEAST_SIGNAL, best_shift, score_surface, stretched

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray]]
#: Kernels by name: ``(fixed, moving, mask, bound)`` to a field ``(dy, dx)`` of no more than ``bound`` pixels.
KERNELS: dict[str, Kernel] = {}
# Fixed value: correlation from which a cell needs no correction.
SKIP = 0.95
PIECE = "role int, ty long, tx long, dy int, dx int, h int, w int, px binary"
FIELD = "ty long, tx long, state string, base double, rigid double, elastic double, shift_y double, shift_x double, field_y binary, field_x binary"
TILE = "y0 long, x0 long, h int, w int, dtype string, px binary"


def kernel(name: str) -> Callable[[Kernel], Kernel]:
    """Register a kernel under a name; a later one of that name takes its place."""

    def add(run: Kernel) -> Kernel:
        KERNELS[name] = run
        return run

    return add


# ---------------------------------------------------------------- one cell


def sample(plane: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places, 0 outside."""
    wide = np.pad(plane, 1)
    y, x = np.clip(y + 1, 0, plane.shape[0] + 0.999), np.clip(x + 1, 0, plane.shape[1] + 0.999)
    i, j = y.astype(np.int64), x.astype(np.int64)
    v, u = y - i, x - j
    return (1 - v) * ((1 - u) * wide[i, j] + u * wide[i, j + 1]) + v * ((1 - u) * wide[i + 1, j] + u * wide[i + 1, j + 1])


def warped(plane: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    y, x = np.mgrid[0 : plane.shape[0], 0 : plane.shape[1]]
    return sample(plane, y - dy, x - dx)


def masked_corr(a: np.ndarray, b: np.ndarray, use: np.ndarray) -> float:
    if use.sum() < 2:
        return 0.0
    x, y = a[use] - a[use].mean(), b[use] - b[use].mean()
    power = (x @ x) * (y @ y)
    return float(x @ y / np.sqrt(power)) if power > 1e-18 else 0.0


def spline_basis(n: int, spacing: float) -> np.ndarray:
    """``[pixel, knot]``: the cubic B-spline of each knot, ``spacing`` pixels apart, at each pixel."""
    knots = int(np.ceil((n - 1) / spacing)) + 3
    t = np.abs(np.arange(n)[:, None] / spacing - (np.arange(knots)[None, :] - 1))
    return np.where(t < 1, 2 / 3 - t * t + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


def smoothed(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian by spectra, mirrored at the edges."""
    pad = int(3 * sigma) + 1
    wide = np.pad(plane, pad, mode="symmetric")
    fy, fx = np.fft.fftfreq(wide.shape[0])[:, None], np.fft.rfftfreq(wide.shape[1])[None, :]
    out = np.fft.irfft2(np.fft.rfft2(wide) * np.exp(-2 * (np.pi * sigma) ** 2 * (fy * fy + fx * fx)), wide.shape)
    return out[pad:-pad, pad:-pad]


@kernel("bspline")
def bspline(fixed: np.ndarray, moving: np.ndarray, use: np.ndarray, bound: float, spacings: tuple[float, ...] = (48.0, 24.0), rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Free-form deformation on a cubic B-spline lattice that climbs the masked correlation.

    The gradient of the correlation is taken to the knots by the basis matrices
    (the field is separable: basis times knots times basis) and smoothed by what
    each knot bears on.  A step moves the field by a pixel at most; one that does
    not gain is halved.  Coarse knots with smoothed planes come first; nothing is
    random, so a lost task repeats its result.
    """
    dy = np.zeros(fixed.shape)
    dx = np.zeros(fixed.shape)
    y, x = np.mgrid[0 : fixed.shape[0], 0 : fixed.shape[1]]
    for level, spacing in enumerate(spacings):
        sigma = 2.0 if level == 0 else 0.8
        a, b = smoothed(fixed, sigma), smoothed(moving, sigma)
        slope_y, slope_x = np.gradient(b)
        by, bx = spline_basis(fixed.shape[0], spacing), spline_basis(fixed.shape[1], spacing)
        reach = by.T @ use.astype(float) @ bx + 1e-3 * spacing
        score, step = masked_corr(a, warped(b, dy, dx), use), 1.0
        for _ in range(rounds):
            w = sample(b, y - dy, x - dx)
            p, q = np.where(use, a - a[use].mean(), 0.0), np.where(use, w - w[use].mean(), 0.0)
            size_p, size_q = np.sqrt((p * p).sum()), np.sqrt((q * q).sum())
            if size_p * size_q < 1e-9:
                break
            pull = (p / size_p - score * q / size_q) / size_q
            moves = [by @ ((by.T @ (-pull * sample(s, y - dy, x - dx)) @ bx) / reach) @ bx.T for s in (slope_y, slope_x)]
            most = max(np.abs(m).max() for m in moves)
            if most < 1e-15:
                break
            while step > 0.02:
                tried = [np.clip(d + step / most * m, -bound, bound) for d, m in zip((dy, dx), moves)]
                better = masked_corr(a, warped(b, *tried), use)
                if better > score + 1e-7:
                    (dy, dx), score, step = tried, better, min(1.0, step * 1.5)
                    break
                step /= 2
            else:
                break
    return dy, dx


def correct(fixed: np.ndarray, moving: np.ndarray, use: np.ndarray, run: Kernel, rigid_bound: int, bound: float, least_signal: int = LEAST_SIGNAL) -> dict:
    """State, scores, whole shift and field of one cell.

    Without ``least_signal`` pixels it abstains; from ``SKIP`` on it is stable.  A
    whole shift, and then an elastic field on top of it, are taken if each gains
    ``LEAST_GAIN`` and reaches ``LEAST_CORR``.
    """
    zero = np.zeros(fixed.shape)
    out = {"state": "abstain", "base": 0.0, "rigid": 0.0, "elastic": 0.0, "shift_y": 0.0, "shift_x": 0.0, "field_y": zero, "field_x": zero}
    if use.sum() < least_signal:
        return out
    a, b = (stretched(p, np.ones(p.shape, bool), use) for p in (fixed, moving))
    base = masked_corr(a, b, use)
    out |= {"state": "stable", "base": base, "rigid": base, "elastic": base}
    if base >= SKIP:
        return out
    takes = lambda old, new: new - old >= LEAST_GAIN and new >= LEAST_CORR
    dy, dx, _, best = best_shift(score_surface(a, b, use, rigid_bound))
    out["state"] = "rejected"
    now = base
    if takes(base, best):
        out |= {"state": "rigid", "shift_y": float(dy), "shift_x": float(dx), "rigid": best, "elastic": best, "field_y": zero + dy, "field_x": zero + dx}
        now = best
    near = warped(b, out["field_y"], out["field_x"])
    field = run(a, near, use, bound)
    # Both shifts in one reading: out[p] = moving[p - elastic(p) - whole].
    both = [whole + own for whole, own in zip((out["field_y"], out["field_x"]), field)]
    best = masked_corr(a, warped(b, *both), use)
    if takes(now, best):
        out |= {"state": "rigid+elastic" if out["state"] == "rigid" else "elastic", "elastic": best, "field_y": both[0], "field_x": both[1]}
    return out


# ---------------------------------------------------------------- tables


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _dealt(size: int, step: int, margin: int, limits: tuple[int, int], roles: tuple[int, ...]):
    """Pieces of tiles for the cells that they meet: cell ``k`` has pixels from ``k * step - margin`` on, ``size + 2 * margin`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block = np.frombuffer(r["px"], np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["h"], r["w"]).astype("<f4")
                spans = []
                for at, n, most in ((r["y0"], r["h"], limits[0]), (r["x0"], r["w"], limits[1])):
                    spans.append([k for k in range(max(0, (at - size - margin) // step), (at + n - 1 + margin) // step + 1) if k * step - margin < at + n and at < k * step + size + margin and k < most])
                for ty in spans[0]:
                    for tx in spans[1]:
                        a, b = max(ty * step - margin, r["y0"]), max(tx * step - margin, r["x0"])
                        own = block[a - r["y0"] : ty * step + size + margin - r["y0"], b - r["x0"] : tx * step + size + margin - r["x0"]]
                        rows.append({"role": r["role"], "ty": ty, "tx": tx, "dy": a - ty * step + margin, "dx": b - tx * step + margin, "h": own.shape[0], "w": own.shape[1], "px": own.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _schema(PIECE))

    return run


def _plane(rows: list[dict], role: int, side: int, fill: float = 0.0) -> np.ndarray:
    out = np.full((side, side), fill)
    for r in rows:
        if r["role"] == role:
            out[r["dy"] : r["dy"] + r["h"], r["dx"] : r["dx"] + r["w"]] = np.frombuffer(r["px"], "<f4").reshape(r["h"], r["w"])
    return out


def lattice(n: int, step: int) -> int:
    """Cells of a side: they begin every ``step`` pixels, and the last one ends at or behind the image."""
    return max(1, -(-n // step) - 1)


def _roles(**images: DataFrame) -> DataFrame:
    out = None
    for k, df in enumerate(images.values()):
        one = df.select(F.lit(k).alias("role"), *[c.split()[0] for c in TILE.split(", ")])
        out = one if out is None else out.unionByName(one)
    return out


def elastic_fields(fixed: DataFrame, moving: DataFrame, mask: DataFrame, height: int, width: int, size: int, rigid_bound: int, bound: float, name: str = "bspline", least_signal: int = LEAST_SIGNAL) -> DataFrame:
    """``FIELD`` of each cell of a lattice of ``size`` pixels with a step of half of it; a group is one cell.

    Pixels outside the image, and those where ``mask`` is 0, do not count.
    """
    run, step = KERNELS[name], size // 2  # the function itself travels with the task
    cells = (lattice(height, step), lattice(width, step))

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        fixed_, moving_, mask_ = (_plane(rows, k, size) for k in range(3))
        told = correct(fixed_, moving_, mask_ > 0, run, rigid_bound, bound, least_signal)
        told |= {"ty": rows[0]["ty"], "tx": rows[0]["tx"], **{k: told[k].astype("<f4").tobytes() for k in ("field_y", "field_x")}}
        return pa.Table.from_pylist([told], _schema(FIELD))

    pieces = _roles(fixed=fixed, moving=moving, mask=mask).mapInArrow(_dealt(size, step, 0, cells, (0, 1, 2)), PIECE)
    return pieces.groupBy("ty", "tx").applyInArrow(one, FIELD)


def trust(k: int, cells: int, size: int) -> np.ndarray:
    """The weight of a cell's pixels on one axis: it falls towards edges inside the image, and stays 1 up to those of the image."""
    at = (np.arange(size) + 0.5) / (size / 2)
    rise, fall = np.minimum(at, 1.0), np.minimum(2.0 - at, 1.0)
    return np.where(k > 0, rise, 1.0) * np.where(k < cells - 1, fall, 1.0)


def blended(fields: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """``(ty, tx, field_y, field_x)`` of output tiles of half the size: means of the cells' fields by ``trust``.

    Each cell gives four quarters; an output tile is summed from at most four of
    them and is done when they are there, whatever the rest of the image.
    """
    half, cells = size // 2, (lattice(height, size // 2), lattice(width, size // 2))
    schema = "ty long, tx long, w binary, field_y binary, field_x binary"

    def quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                w = np.outer(trust(r["ty"], cells[0], size), trust(r["tx"], cells[1], size))
                parts = [w, *(np.frombuffer(r[k], "<f4").reshape(size, size) * w for k in ("field_y", "field_x"))]
                for i in (0, 1):
                    for j in (0, 1):
                        cut = [p[i * half : (i + 1) * half, j * half : (j + 1) * half].astype("<f8").tobytes() for p in parts]
                        rows.append(dict(zip(("ty", "tx", "w", "field_y", "field_x"), (r["ty"] + i, r["tx"] + j, *cut))))
            yield pa.RecordBatch.from_pylist(rows, _schema(schema))

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["w"])  # the same order whenever the task is run
        w, dy, dx = (sum(np.frombuffer(r[k], "<f8") for r in rows) for k in ("w", "field_y", "field_x"))
        out = {"ty": rows[0]["ty"], "tx": rows[0]["tx"], "field_y": (dy / w).astype("<f4").tobytes(), "field_x": (dx / w).astype("<f4").tobytes()}
        return pa.Table.from_pylist([out], _schema("ty long, tx long, field_y binary, field_x binary"))

    inside = f"ty * {half} < {height} and tx * {half} < {width}"
    return fields.select("ty", "tx", "field_y", "field_x").mapInArrow(quarters, schema).where(inside).groupBy("ty", "tx").applyInArrow(add, "ty long, tx long, field_y binary, field_x binary")


def apply_field(moving: DataFrame, fields: DataFrame, height: int, width: int, half: int, bound: int) -> DataFrame:
    """The moved image as tiles of ``half`` pixels; each gets a halo of ``bound`` pixels, what the field can reach."""
    margin, cells = bound + 1, (-(-height // half), -(-width // half))
    pieces = _roles(moving=moving).mapInArrow(_dealt(half, half, margin, cells, (0,)), PIECE)
    side = half + 2 * margin

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.Table.from_pylist([], _schema(TILE))
        r = right.to_pylist()[0]
        dy, dx = (np.frombuffer(r[k], "<f4").reshape(half, half) for k in ("field_y", "field_x"))
        y, x = np.mgrid[0:half, 0:half] + margin
        got = sample(_plane(left.to_pylist(), 0, side), y - dy, x - dx)[: height - r["ty"] * half, : width - r["tx"] * half].astype("<f4")
        return pa.Table.from_pylist([{"y0": r["ty"] * half, "x0": r["tx"] * half, "h": got.shape[0], "w": got.shape[1], "dtype": "float32", "px": got.tobytes()}], _schema(TILE))

    return pieces.groupBy("ty", "tx").cogroup(fields.groupBy("ty", "tx")).applyInArrow(one, TILE)


def touch_up(fixed: DataFrame, moving: DataFrame, mask: DataFrame, height: int, width: int, size: int, rigid_bound: int = 16, bound: float = 12.0, name: str = "bspline", least_signal: int = LEAST_SIGNAL) -> DataFrame:
    """``moving`` brought onto ``fixed`` as tiles of half of ``size``: fields of all cells, blended, applied in one pass."""
    fields = blended(elastic_fields(fixed, moving, mask, height, width, size, rigid_bound, bound, name, least_signal), height, width, size)
    return apply_field(moving, fields, height, width, size // 2, int(np.ceil(rigid_bound + bound)))
