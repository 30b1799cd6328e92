"""The nearest source of every pixel, what follows from it, and peaks that keep a distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import map_groups
from ..functions.joins import by_sort
from ..scratch import Steps


def nearest_source(sources: DataFrame, height: int, width: int) -> DataFrame:
    """``(y, x, d2, sy, sx)``: the source ``(y, x)`` nearest to each pixel of the plane and its squared distance.

    Exact, in two passes: the nearest source of each column, then of each row the
    nearest of what its columns have, looking no further than the distance found.
    Of equal distances the source of the smallest ``(y, x)`` counts.  A group is
    one column or one row; a plane without sources gives no rows.
    """

    def column(table: pa.Table) -> pa.Table:
        at = np.unique(table.column("y").to_numpy())
        y = np.arange(height)
        above = np.clip(np.searchsorted(at, y, "right") - 1, 0, len(at) - 1)
        below = np.clip(above + 1, 0, len(at) - 1)
        near = np.where(np.abs(at[below] - y) < np.abs(at[above] - y), at[below], at[above])
        x = int(table.column("x")[0].as_py())
        return pa.table({"y": y, "x": np.full(height, x), "sy": near})

    def row(table: pa.Table) -> pa.Table:
        y = int(table.column("y")[0].as_py())
        far = 1 << 60
        sy, cost = np.full(width, far), np.full(width, far)
        at = table.column("x").to_numpy()
        sy[at] = table.column("sy").to_numpy()
        cost[at] = (sy[at] - y) ** 2
        best, by, bx = cost.copy(), sy.copy(), np.arange(width)
        for k in range(1, width):
            if k * k > best.max():
                break
            for to, of in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
                d, ny, nx = cost[of] + k * k, sy[of], np.arange(width)[of]
                old, oy, ox = best[to], by[to], bx[to]
                closer = (cost[of] < far) & ((d < old) | ((d == old) & ((ny < oy) | ((ny == oy) & (nx < ox)))))
                best[to], by[to], bx[to] = np.where(closer, d, old), np.where(closer, ny, oy), np.where(closer, nx, ox)
        return pa.table({"y": np.full(width, y), "x": np.arange(width), "d2": best, "sy": by, "sx": bx})

    places = sources.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    columns = places.groupBy("x").applyInArrow(column, "y long, x long, sy long")
    return map_groups(columns, "y", row, "y long, x long, d2 long, sy long, sx long")


def dense_field(regions: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """``(y, x, dy, dx)`` of every pixel: the shift ``(label, dy, dx)`` of the region ``(y, x, label)`` that it lies in or nearest to.

    Regions without a shift do not count.
    """
    held = regions.join(shifts, "label")
    source = held.select(F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"), "dy", "dx")
    return nearest_source(held, height, width).join(source, ["sy", "sx"]).select("y", "x", "dy", "dx")


def spaced_peaks(peaks: DataFrame, spacing: int) -> DataFrame:
    """``(y, x, v)`` of the peaks that greedy choice keeps: by falling value, then by place, each one more than ``spacing`` rows or columns away from all kept before it.

    In rounds: a peak that leads all open ones within reach is kept, and those
    within its reach leave.  Only peaks that chains of higher neighbours hold back
    wait for another round; peaks meet in cells of ``spacing`` pixels, never all pairs.
    """
    steps = Steps(peaks.sparkSession, "peaks", keep_all=True)
    cell = spacing + 1
    kept, open_ = None, steps.save(peaks.select("y", "x", "v").distinct())
    rank = lambda p="": F.struct(F.col(f"{p}v"), -F.col(f"{p}y"), -F.col(f"{p}x"))
    around = F.explode(F.array(*[F.struct((F.expr(f"floor(y / {cell})") + a).alias("cy"), (F.expr(f"floor(x / {cell})") + b).alias("cx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = (F.abs(F.col("y") - F.col("oy")) <= spacing) & (F.abs(F.col("x") - F.col("ox")) <= spacing)

    def met(these: DataFrame, others: DataFrame) -> DataFrame:
        own = these.withColumn("c", around).select("y", "x", "v", "c.*")
        other = others.select(F.expr(f"floor(y / {cell})").alias("cy"), F.expr(f"floor(x / {cell})").alias("cx"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("v").alias("ov"))
        return own.join(by_sort(other), ["cy", "cx"]).where(near)

    while not open_.isEmpty():
        lead = met(open_, open_).groupBy("y", "x", "v").agg(F.max(rank("o")).alias("top")).where(F.col("top") == rank()).select("y", "x", "v")
        lead = steps.save(lead)
        kept = lead if kept is None else kept.unionByName(lead)
        open_ = steps.save(open_.join(by_sort(met(open_, lead).select("y", "x").distinct()), ["y", "x"], "left_anti").select("y", "x", "v"))
    return open_ if kept is None else kept
