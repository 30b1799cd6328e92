"""Queries of TIFF containers, with SQL: what is written as a pyramidal file is read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pyramid as P
from ..scratch import Steps
from ..sources import bigtiff as B
from . import inputs as I
from .catalog import CTES, query, sql

# A plane for each return flag that grows with the suppliers: a row for each of them.
CTES["plane"] = "select channel, y, x, coalesce(v, 0) as v from (select unnest(range(3)) as channel) a cross join (select unnest(range((select max(l_suppkey) + 1 from lineitem))) as y) b cross join (select unnest(range(64)) as x) c left join (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as channel, l_suppkey as y, l_partkey % 64 as x, cast(sum(cast(l_quantity as bigint)) * 37 % 65536 as bigint) as v from lineitem group by 1, 2, 3) d using (channel, y, x)"
HALVED = "select channel, y // 2 as y, x // 2 as x, cast(round_even(avg(v), 0) as bigint) as v from {} group by 1, 2, 3"
TILED = "select cast({} as bigint) as level, cast(channel as bigint) as channel, y // 16 as tile_y, x // 16 as tile_x, count(*) as n, cast(sum(v) as bigint) as total, cast(sum(v * ((y % 16) * 16 + x % 16 + 1)) as bigint) as check from {} group by 2, 3, 4"


def _written(spark, d) -> str:
    """The planes as a pyramidal BigTIFF of three levels in the shared folder."""
    height = I.table(spark, d, "lineitem").agg(F.max("l_suppkey")).first()[0] + 1
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    pixels = I.table(spark, d, "lineitem").groupBy(flag.alias("channel"), F.col("l_suppkey").alias("y"), (F.col("l_partkey") % 64).alias("x")).agg((F.sum(F.col("l_quantity").cast("bigint")) * 37 % 65536).alias("v"))
    layout, path = B.Layout(3, height, 64, "uint16", 16, 3, ("A", "N", "R")), f"{Steps(spark, 'tiff').path}/plane.ome.tif"
    B.write_pyramid(B.tiles_of(pixels, layout), path, layout)
    return path


@query(sql(f", l1 as ({HALVED.format('plane')}), l2 as ({HALVED.format('l1')}) " + " union all ".join(TILED.format(k, name) for k, name in enumerate(("plane", "l1", "l2"))), "plane"))
def tiff_levels(spark, d):
    """All levels of all channels, tile by tile."""
    pixels = B.to_pixels(B.read_tiles(spark, _written(spark, d)))
    return P.tile_table(pixels.select(F.struct("level", "channel").alias("channel"), "y", "x", "v"), 16).select(F.col("channel.level").cast("long").alias("level"), F.col("channel.channel").cast("long").alias("channel"), "tile_y", "tile_x", "n", "total", "check")


@query(sql("select g.y, h.x, coalesce(v, 0) * 1e0 as v from range(-5, 70) g(y) cross join range(30, 75) h(x) left join plane p on p.channel = 1 and p.y = g.y and p.x = h.x", "plane"))
def tiff_box(spark, d):
    """A box of one channel that reaches beyond the image; only its tiles are read."""
    return B.read_box(spark, _written(spark, d), 1, (-5, 70, 30, 75))


@query(sql(f", l1 as ({HALVED.format('plane')}) select cast(channel as bigint) as channel, count(*) as n, min(v) as least, max(v) as most, cast(sum(v) as bigint) as total from l1 where y < 32 group by 1", "plane"))
def tiff_strip(spark, d):
    """Statistics of the first rows of the second level: the filters on level and row reach the source."""
    tiles = B.read_tiles(spark, _written(spark, d)).where("level = 1 and y0 < 32")
    return B.to_pixels(tiles).groupBy(F.col("channel").cast("long").alias("channel")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"))
