"""Queries of merged cycles, with SQL: the file is read back, its channels where the reference has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pyramid as P
from ..scratch import Steps
from ..sources import bigtiff as B
from ..sources import cycles as C
from . import inputs as I
from .catalog import query, sql
from .containers import HALVED, TILED

# Fixed values of the input: the second cycle is the first one's slide read three rows below and two columns to the left.
DY, DX, WIDTH = 3, -2, 64
# Cycle 1 has the planes of A and N, cycle 2 those of A and R; what the second one did not see is 0.
MERGED = f"select channel, y, x, v from plane where channel < 2 union all select case channel when 0 then 2 else 3 end as channel, y, x, case when y >= {DY} and x < {WIDTH + DX} then v else 0 end as v from plane where channel <> 1"


def _cycles(spark, d) -> tuple[list[C.Cycle], int]:
    height = (I.table(spark, d, "lineitem").agg(F.max("l_suppkey")).first()[0] or 0) + 1
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    pixels = I.table(spark, d, "lineitem").groupBy(flag.alias("channel"), F.col("l_suppkey").alias("y"), (F.col("l_partkey") % WIDTH).alias("x")).agg((F.sum(F.col("l_quantity").cast("bigint")) * 37 % 65536).alias("v"))
    layout = B.Layout(2, height, WIDTH, "uint16", 64, 1, ("DAPI", "marker"))
    second = pixels.where("channel <> 1").select(F.expr("channel div 2").alias("channel"), (F.col("y") - DY).alias("y"), (F.col("x") - DX).alias("x"), "v")
    tiles = [B.tiles_of(of, layout) for of in (pixels.where("channel < 2"), second)]
    return [C.Cycle(k + 1, of, layout.names, height, WIDTH, "uint16", d) for k, of in enumerate(tiles)], height


@query(sql(f", m as ({MERGED}), l1 as ({HALVED.format('m')}) " + " union all ".join(TILED.format(k, name) for k, name in enumerate(("m", "l1"))), "plane"))
def cycles_merged(spark, d):
    """All levels of two cycles in one file, the second registered onto the first."""
    cycles, _ = _cycles(spark, d)
    path = f"{Steps(spark, 'cycles').path}/merged.ome.tif"
    C.merge(spark, cycles, path, C.Settings(size=64, coarse=1, steps=1, tile=16, levels=2))
    pixels = B.to_pixels(B.read_tiles(spark, path))
    return P.tile_table(pixels.select(F.struct("level", "channel").alias("channel"), "y", "x", "v"), 16).select(F.col("channel.level").cast("long").alias("level"), F.col("channel.channel").cast("long").alias("channel"), "tile_y", "tile_x", "n", "total", "check")
