"""Raster tables derived from the bundled relational ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import by_sort

#: Size of the derived planes.
H, W = 48, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir)


def px2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cycle and channel; filters on them reach the scan."""
    return _pixels(spark, sf_dir, F.col("l_linestatus").alias("cycle"), F.col("l_returnflag").alias("channel"))


def _pixels(spark: SparkSession, sf_dir: str, *by) -> DataFrame:
    place = [(F.col("l_orderkey") % H).alias("y"), (F.col("l_partkey") % W).alias("x")]
    return table(spark, sf_dir, "lineitem").groupBy(*by, *place).agg((F.sum(F.col("l_quantity").cast("bigint")) * 37 % 65536).alias("v"))


def foreground(spark: SparkSession, sf_dir: str, p: float = 0.7) -> DataFrame:
    all_ = px(spark, sf_dir)
    limit = all_.agg(F.percentile("v", F.lit(p)).alias("limit"))  # one row
    return all_.crossJoin(F.broadcast(limit)).where("v > limit").drop("limit")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground pixels labelled by their 8 x 8 cell."""
    return foreground(spark, sf_dir).select("y", "x", F.expr("(y div 8) * 8 + x div 8 + 1").alias("label"))


def disc_height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the plane of discs: twelve for each five suppliers."""
    return ((table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] or 0) // 5 + 1) * 12


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted discs, one for each supplier: ``(y, x, label, v)``."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    spot = k.select("k", F.expr("6 + 12 * (k div 5)").alias("cy"), F.expr("6 + 13 * (k % 5)").alias("cx"), F.expr("3 + k % 3").alias("r"))
    rows = spot.withColumn("y", F.explode(F.expr("sequence(cy - r, cy + r)"))).withColumn("x", F.explode(F.expr("sequence(cx - r, cx + r)")))
    inside = rows.where("(y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r")
    return inside.groupBy("y", "x").agg((F.min("k") + 1).alias("label"), (F.min("k") * 100 + 20000).alias("v"))


def disc_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discs on their background of 120."""
    grid = spark.range(disc_height(spark, sf_dir)).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(W - 1).cast("long"))).alias("x"))
    return grid.join(by_sort(discs(spark, sf_dir)), ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(120)).cast("long").alias("v"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 6 x 5 grid of tiles; each right and lower neighbour has the mean of some orders as its estimate."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 6).alias("gx"), (F.col("o_orderkey") % 5).alias("gy"), (F.col("o_orderkey") % 2).alias("axis"), F.floor("o_totalprice").cast("long").alias("p"))
    g = o.groupBy("gx", "gy", "axis").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    src = F.expr("gy * 6 + gx")
    e = g.where("(axis = 0 and gx < 5) or (axis = 1 and gy < 4)")
    return e.select(
        F.when(F.col("axis") == 0, "x").otherwise("y").alias("axis"), src.alias("src"), F.when(F.col("axis") == 0, src + 1).otherwise(src + 6).alias("dst"),
        F.when(F.col("axis") == 0, F.col("s") % 7 - 3).otherwise(90 + F.col("s") % 9).cast("double").alias("dy"),
        F.when(F.col("axis") == 0, 90 + F.col("s") % 9).otherwise(F.col("s") % 5 - 2).cast("double").alias("dx"),
        (F.col("s") % 40).cast("double").alias("overlap"), (F.lit(1.0) - (F.col("s") % 16) / 100.0).alias("score"),
        (F.col("s") % 11 == 0).alias("fallback"), (F.col("s") % 7 == 0).alias("unmasked"), (F.col("s") % 1000).alias("fg_px"), ((F.col("s") % 100) / 100.0).alias("fg_frac"),
    )


def elastic_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration tiles on a grid of suppliers."""
    s = table(spark, sf_dir, "supplier")
    cents = F.floor(F.abs("s_acctbal") * 100).cast("long")
    state = F.when(F.col("c") % 4 == 0, "accepted").when(F.col("c") % 4 == 1, "stable_zero").otherwise("borrowed")
    rows = s.select(F.col("s_suppkey").alias("tile"), (F.col("s_nationkey") % 3).cast("long").alias("island"), F.expr("s_suppkey div 10 * 10").alias("y0"), F.expr("s_suppkey % 10 * 10").alias("x0"), cents.alias("c"))
    return rows.select("tile", "island", "y0", "x0", (F.col("y0") + 5.0).alias("cy"), (F.col("x0") + 5.0).alias("cx"), (F.col("c") % 41 - 20).cast("double").alias("dy"), (F.col("c") % 31 - 15).cast("double").alias("dx"), ((F.col("c") % 50) / 100.0).alias("gain"), state.alias("state"))
