"""Nuclei and cells by rules over the whole plane: smoothed probabilities, one depth for all masks, seeds as rows.

Smoothing, masks, depths, the depth that counts as core, and seeds are relations;
only the flood of one connected mask runs in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import map_groups
from ..functions.joins import by_sort
from ..scratch import Steps
from . import nearest as NE
from . import neighbourhood as N
from .graph import components, drop_small, relabel
from .segmentation import flood


def depths(region: DataFrame, height: int, width: int) -> DataFrame:
    """``(y, x, d2)`` of each pixel of ``region``: the squared distance to the nearest pixel of the plane outside it, 0 if there is none.

    The nearest one outside always touches the region, so only those are sources.
    """
    rim = N.dilate(region, N.CROSS, height, width).join(by_sort(region.select("y", "x")), ["y", "x"], "left_anti")
    return region.select("y", "x").join(by_sort(NE.nearest_source(rim, height, width).select("y", "x", "d2")), ["y", "x"], "left").select("y", "x", F.coalesce("d2", F.lit(0)).alias("d2"))


def upper(depth: DataFrame, share: float) -> DataFrame:
    """The pixels at least as deep as the ``share`` of all, by distance; a count for each depth meets in one row."""
    limit = depth.agg(F.percentile(F.sqrt("d2"), F.lit(share)).alias("limit"))  # one row
    return depth.crossJoin(F.broadcast(limit)).where((F.sqrt("d2") >= F.col("limit")) & (F.col("d2") > 0)).drop("limit")


def seeds(core: DataFrame, height: int, width: int, window: int = 7, spacing: int = 4) -> DataFrame:
    """``(y, x, d2)``: pixels of ``core(y, x, d2)`` that are deepest in their window, chosen greedily ``spacing`` apart; of equal ones the first by place."""
    tops = N.local_peaks(core.select("y", "x", F.col("d2").alias("v")), window // 2, height, width)
    return NE.spaced_peaks(tops, spacing - 1).select("y", "x", F.col("v").alias("d2"))


def smoothed(plane: DataFrame, column: str, sigma: float, height: int, width: int) -> DataFrame:
    """``(y, x, v)``: a column after a Gaussian, to nine decimals so that thresholds do not depend on the order of sums."""
    rows = plane.select("y", "x", F.col(column).cast("double").alias("v"))
    return N.gaussian(rows, sigma, height, width).select("y", "x", F.round("v", 9).alias("v")) if sigma > 0 else rows


def nucleus_mask(prob: DataFrame, height: int, width: int, threshold: float, least: int) -> DataFrame:
    """``(y, x, label)``: pixels ``(y, x, v)`` above the threshold, opened and closed, in pieces of at least ``least``."""
    mask = N.closed(N.opened(prob.where(F.col("v") >= threshold), N.CROSS, height, width), N.CROSS, height, width)
    return drop_small(components(mask, height, width), least)


def flooded(mask: DataFrame, core: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """``(y, x, label)``: each connected mask ``(y, x, label)`` is flooded from its seeds, deepest first; without seeds it has no rows.

    If no mask has a seed, each is one object.
    """
    if chosen.isEmpty():
        return mask.select("y", "x", "label")

    def run(table: pa.Table) -> pa.Table:
        y, x, depth, seed = (table.column(c).to_numpy() for c in ("y", "x", "depth", "seed"))
        oy, ox = y.min(), x.min()
        shape = (y.max() - oy + 1, x.max() - ox + 1)
        inside, low, start = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape, np.int64)
        inside[y - oy, x - ox], low[y - oy, x - ox], start[y - oy, x - ox] = True, -depth, seed
        out = flood(low, start, inside)[y - oy, x - ox]
        return pa.table({"y": y, "x": x, "label": out}).filter(pa.array(out > 0))

    place = (F.col("y") * width + F.col("x") + 1).alias("seed")
    rows = mask.join(by_sort(core.select("y", "x", F.sqrt("d2").alias("depth"))), ["y", "x"], "left").join(by_sort(chosen.select("y", "x", place)), ["y", "x"], "left")
    rows = rows.select("y", "x", "label", F.coalesce("depth", F.lit(0.0)).alias("depth"), F.coalesce("seed", F.lit(0)).cast("long").alias("seed"))
    return map_groups(rows, "label", run, "y long, x long, label long")


def nucleus_markers(prob: DataFrame, height: int, width: int, threshold: float = 0.35, least: int = 30, spacing: int = 4, window: int = 7, sigma: float = 1.0, share: float = 0.7) -> DataFrame:
    """Nuclei ``(y, x, label)`` of a whole probability plane ``(y, x, p)``.

    Seeds are the peaks of the depth inside the mask, of the depths above the
    ``share`` of the whole plane; masks without one are left out, as are parts
    below ``least``.  An empty mask gives an empty table.
    """
    steps = Steps(prob.sparkSession, "nuclei", keep_all=True)  # what later steps read more than once
    mask = steps.save(nucleus_mask(smoothed(prob, "p", sigma, height, width), height, width, threshold, least))
    core = steps.save(upper(depths(mask, height, width), share))
    return relabel(drop_small(steps.save(flooded(mask, core, steps.save(seeds(core, height, width, window, spacing)), width)), least))


def boundary_markers(probs: DataFrame, height: int, width: int, threshold: float = 0.35, core: float = 0.45, boundary: float = 0.35, reach: int = 2, least: int = 30, spacing: int = 4, window: int = 7, sigma: float = 1.0, share: float = 0.7) -> DataFrame:
    """Nuclei of planes ``(y, x, p, boundary)``: as ``nucleus_markers``, with seeds only where no boundary is within ``reach``.

    The region of seeds is where ``p`` is at least ``core``, in pieces of a quarter
    of ``least`` (and of 5); a plane without such a region takes the whole mask.
    """
    steps = Steps(probs.sparkSession, "nuclei", keep_all=True)  # what later steps read more than once
    p = steps.save(smoothed(probs, "p", sigma, height, width))
    mask = steps.save(nucleus_mask(p, height, width, threshold, least))
    rim = N.dilate(smoothed(probs, "boundary", sigma, height, width).where(F.col("v") >= boundary), N.disk(reach), height, width)
    inner = mask.join(by_sort(p.where(F.col("v") >= core).select("y", "x")), ["y", "x"], "left_semi").join(by_sort(rim), ["y", "x"], "left_anti")
    inner = steps.save(drop_small(components(inner, height, width), max(5, least // 4)))
    deep = steps.save(upper(depths(mask if inner.isEmpty() else inner, height, width), share))
    return relabel(drop_small(steps.save(flooded(mask, deep, steps.save(seeds(deep, height, width, window, spacing)), width)), least))


def cells(nuclei: DataFrame, probs: DataFrame, height: int, width: int, threshold: float = 0.35, background: float | None = 0.5, weight: float = 0.5, reach: int | None = 80, least: int = 200) -> DataFrame:
    """Cells ``(y, x, label)``: nuclei ``(y, x, label)`` grow over planes ``(y, x, p, background)``.

    They grow where the cytoplasm ``p`` is likely or a nucleus is, not where the
    background is, and to ``reach`` pixels from any nucleus; from high to low ``p``
    less ``weight`` times the background.  ``background`` None: the plane needs no
    such column; ``reach`` None: any distance.  Cells below ``least`` go.
    """
    q = F.coalesce("background", F.lit(0.0)) if background is not None else F.lit(0.0)
    field = probs.select("y", "x", F.col("p").cast("double").alias("p"), q.alias("q")).join(by_sort(nuclei.select("y", "x", F.col("label").alias("seed"))), ["y", "x"], "left")
    allowed = field.where((F.col("p") >= threshold) | F.col("seed").isNotNull())
    if background is not None:
        allowed = allowed.where(F.col("q") < background)
    if reach is not None:
        near = NE.nearest_source(nuclei, height, width).where(F.col("d2") <= reach * reach).select("y", "x")
        allowed = allowed.join(by_sort(near), ["y", "x"], "left_semi")
    steps = Steps(probs.sparkSession, "cells", keep_all=True)  # what later steps read more than once
    allowed = steps.save(allowed)
    masks = components(allowed, height, width)

    def run(table: pa.Table) -> pa.Table:
        y, x, seed, height_ = (table.column(c).to_numpy() for c in ("y", "x", "seed", "elevation"))
        oy, ox = y.min(), x.min()
        shape = (y.max() - oy + 1, x.max() - ox + 1)
        inside, low, start = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape, np.int64)
        inside[y - oy, x - ox], low[y - oy, x - ox], start[y - oy, x - ox] = True, height_, seed
        out = flood(low, start, inside)[y - oy, x - ox]
        return pa.table({"y": y, "x": x, "label": out}).filter(pa.array(out > 0))

    rows = allowed.join(by_sort(masks), ["y", "x"]).select("y", "x", "label", F.coalesce("seed", F.lit(0)).cast("long").alias("seed"), (weight * F.col("q") - F.col("p")).alias("elevation"))
    return relabel(drop_small(steps.save(map_groups(rows, "label", run, "y long, x long, label long")), least))
