"""Instances from probability planes.

Thresholds, cleaning and components are relational; the flood itself is
sequential by nature and runs in numpy, once for each connected mask, so groups
are as small as the objects that touch.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import map_groups
from ..functions.joins import by_sort
from ..scratch import Steps
from . import nearest as NE
from .graph import components, drop_small, relabel
from .neighbourhood import CROSS, closed, dilate, opened


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest place outside ``mask``, whose border counts as outside."""
    wide = np.pad(mask, 1)
    big = float(sum(wide.shape)) ** 2
    column = np.where(wide, big, 0.0)
    for y in range(1, wide.shape[0]):
        column[y] = np.where(wide[y], np.minimum(column[y], (np.sqrt(column[y - 1]) + 1) ** 2), 0.0)
    for y in range(wide.shape[0] - 2, -1, -1):
        column[y] = np.minimum(column[y], (np.sqrt(column[y + 1]) + 1) ** 2)
    x = np.arange(wide.shape[1])
    gap = (x[:, None] - x[None, :]) ** 2
    return np.sqrt(np.stack([(row[None, :] + gap).min(1) for row in column]))[1:-1, 1:-1]


def peaks(height: np.ndarray, mask: np.ndarray, spacing: int) -> list[tuple[int, int]]:
    """Local maxima by falling height, none within ``spacing`` (of the larger axis) of one before."""
    order = sorted(zip(*np.nonzero(mask)), key=lambda p: (-height[p], p))
    taken = np.zeros(mask.shape, bool)
    out = []
    for y, x in order:
        near = height[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        if not taken[y, x] and height[y, x] >= near.max():
            out.append((int(y), int(x)))
            taken[max(0, y - spacing) : y + spacing + 1, max(0, x - spacing) : x + spacing + 1] = True
    return out


def flood(elevation: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Watershed by a queue on elevation, then age; 4-neighbours."""
    out, heap, age = markers.copy(), [], 0
    for y, x in zip(*np.nonzero(markers)):
        heapq.heappush(heap, (elevation[y, x], age, int(y), int(x)))
        age += 1
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not out[ny, nx]:
                out[ny, nx] = out[y, x]
                heapq.heappush(heap, (elevation[ny, nx], age, ny, nx))
                age += 1
    return out


def split_touching(masks: DataFrame, width: int, spacing: int = 3) -> DataFrame:
    """``(y, x, label)`` from connected masks ``(y, x, label)``: one object for each peak of the distance."""

    def run(table: pa.Table) -> pa.Table:
        ys, xs = (table.column(c).to_numpy() for c in ("y", "x"))
        oy, ox = ys.min(), xs.min()
        mask = np.zeros((ys.max() - oy + 1, xs.max() - ox + 1), bool)
        mask[ys - oy, xs - ox] = True
        d = distance(mask)
        seeds = np.zeros(mask.shape, np.int64)
        for y, x in peaks(d, mask, spacing):
            seeds[y, x] = (y + oy) * width + x + ox + 1
        found = flood(-d, seeds, mask)
        return pa.table({"y": ys, "x": xs, "label": found[ys - oy, xs - ox]})

    return map_groups(masks, "label", run, "y long, x long, label long")


def nuclei(prob: DataFrame, height: int, width: int, threshold: float = 0.35, least: int = 30, spacing: int = 3) -> DataFrame:
    """Nuclei from a probability plane ``(y, x, p)``: threshold, open, close, drop small, split, number."""
    mask = closed(opened(prob.where(F.col("p") >= threshold), CROSS, height, width), CROSS, height, width)
    whole = drop_small(components(mask, height, width, diagonal=True), least)
    split = Steps(prob.sparkSession, "split").save(split_touching(whole, width, spacing))  # read more than once
    return relabel(drop_small(split, max(1, least // 4)))


def boundary_nuclei(probs: DataFrame, height: int, width: int, threshold: float = 0.35, core: float = 0.45, boundary: float = 0.35, background: float = 0.6, least: int = 30, spacing: int = 4, share: float = 0.7) -> DataFrame:
    """Nuclei of planes ``(y, x, p, boundary, background)``: as ``nuclei``, with seeds that keep away from boundaries.

    The mask is where ``p`` is high and the background is not.  Its core is where
    ``p`` is higher still, further than two pixels from any boundary, in pieces of
    at least a quarter of ``least``; a mask without a core is its own.  Seeds are
    the peaks of the distance within the core, of its upper part only; they flood
    the whole mask.  A group is one connected mask.
    """
    near = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
    inside = probs.where((F.col("p") >= threshold) & (F.coalesce("background", F.lit(0.0)) < background))
    mask = closed(opened(inside, CROSS, height, width), CROSS, height, width)
    whole = drop_small(components(mask, height, width, diagonal=True), least)
    edge = dilate(probs.where(F.col("boundary") >= boundary), near, height, width)
    inner = whole.join(by_sort(probs.where(F.col("p") >= core).select("y", "x")), ["y", "x"], "left_semi").join(by_sort(edge), ["y", "x"], "left_anti")
    inner = drop_small(components(inner, height, width), max(5, least // 4)).select("y", "x", F.lit(True).alias("core"))

    def run(table: pa.Table) -> pa.Table:
        ys, xs, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "core"))
        oy, ox = ys.min(), xs.min()
        mask, seeded = np.zeros((2, ys.max() - oy + 1, xs.max() - ox + 1), bool)
        mask[ys - oy, xs - ox], seeded[ys - oy, xs - ox] = True, own
        seeded = seeded if seeded.any() else mask
        d = distance(seeded)
        d[d < np.quantile(d[seeded], share)] = 0
        seeds = np.zeros(mask.shape, np.int64)
        for y, x in peaks(d, seeded, spacing):
            seeds[y, x] = (y + oy) * width + x + ox + 1
        found = flood(-d, seeds, mask)
        return pa.table({"y": ys, "x": xs, "label": found[ys - oy, xs - ox]})

    marked = whole.join(by_sort(inner), ["y", "x"], "left").select("y", "x", "label", F.coalesce("core", F.lit(False)).alias("core"))
    split = Steps(probs.sparkSession, "split").save(map_groups(marked, "label", run, "y long, x long, label long"))  # read more than once
    return relabel(drop_small(split, least))


def grow_cells(nuclei_: DataFrame, cyto: DataFrame, height: int, width: int, threshold: float = 0.35, reach: int = 80, least: int = 1) -> DataFrame:
    """Cells from nuclei: labels flood the cytoplasm ``(y, x, p)`` from high to low probability, up to ``reach`` pixels away.

    What is further from every nucleus is left out before the flood, so that a
    group is one connected mask of pixels near nuclei, not the whole cytoplasm.
    """
    field = cyto.where(F.col("p") >= threshold).select("y", "x", "p").join(by_sort(nuclei_), ["y", "x"], "full").select("y", "x", F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("label", F.lit(0)).cast("long").alias("seed"))
    near = NE.nearest_source(nuclei_, height, width).where(F.col("d2") <= reach * reach).select("y", "x")
    field = Steps(cyto.sparkSession, "near").save(field.join(by_sort(near), ["y", "x"], "left_semi"))  # read more than once
    masks = components(field.select("y", "x"), height, width)

    def run(table: pa.Table) -> pa.Table:
        ys, xs, seed, own = (table.column(c).to_numpy() for c in ("y", "x", "seed", "p"))
        oy, ox = ys.min(), xs.min()
        shape = (ys.max() - oy + 1, xs.max() - ox + 1)
        mask, seeds, p = np.zeros(shape, bool), np.zeros(shape, np.int64), np.zeros(shape)
        mask[ys - oy, xs - ox], seeds[ys - oy, xs - ox], p[ys - oy, xs - ox] = True, seed, own
        label = flood(-p, seeds, mask)[ys - oy, xs - ox]
        return pa.table({"y": ys, "x": xs, "label": label}).filter(pa.array(label > 0))

    grown = Steps(cyto.sparkSession, "grown").save(map_groups(field.join(by_sort(masks), ["y", "x"]), "label", run, "y long, x long, label long"))  # read more than once
    return drop_small(grown, least)
