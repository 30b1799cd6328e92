"""Pyramid levels, chunk windows, physical sizes and resuming, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import by_sort
from ..scratch import Steps
from .geometry import block_mean


def level_shapes(images: DataFrame, least: int = 128, most: int = 40) -> DataFrame:
    """``(image, level, h, w)`` of images ``(image, h, w)``: sides halve, rounded up, while both are above ``least``; level 0 is the image."""
    size = lambda n, k: F.ceil(F.col(n) / F.expr(f"shiftleft(1L, {k})")).cast("long")
    # The smaller side decides how many levels there are: ceil(n / 2^k) is n halved k times, rounded up each time.
    short = F.least("h", "w")
    above = lambda k: F.ceil(short / F.expr(f"shiftleft(1L, {k})")) > least
    n = F.aggregate(F.array(*[F.when(above(k), 1).otherwise(0) for k in range(most)]), F.lit(0), lambda a, x: a + x)
    rows = images.withColumn("level", F.explode(F.sequence(F.lit(0), n)))
    return rows.select("image", F.col("level").cast("long").alias("level"), size("h", "level").alias("h"), size("w", "level").alias("w"))


def conversion_ticks(images: DataFrame, least: int = 128, chunk: int = 1024) -> DataFrame:
    """``(image, ticks)``: a step for each chunk of each level, one to write each level, one for the base."""
    chunks = F.ceil(F.col("h") / chunk) * F.ceil(F.col("w") / chunk)
    return level_shapes(images, least).groupBy("image").agg((F.sum(F.when(F.col("level") > 0, chunks + 1).otherwise(F.lit(1)))).cast("long").alias("ticks"))


def inspect(levels: DataFrame) -> DataFrame:
    """``(image, series, n_levels, h, w, pyramidal)`` of level rows ``(image, series, level, h, w)``: the base series is the largest at full size, the first of equals."""
    series = levels.groupBy("image", "series").agg(F.count("*").alias("n_levels"), F.min_by(F.struct("h", "w"), "level").alias("base"))
    rank = F.struct(F.col("base.h") * F.col("base.w"), -F.col("series"))
    return series.groupBy("image").agg(F.max_by(F.struct("series", "n_levels", "base.h", "base.w"), rank).alias("b"), F.bool_or(F.col("n_levels") > 1).alias("pyramidal")).select("image", "b.series", "b.n_levels", "b.h", "b.w", "pyramidal")


def nearest_level(levels: DataFrame, factor: int) -> DataFrame:
    """``(image, level)``: the level whose height is nearest the height over ``factor``, the first of equals; 0 if the image has no other."""
    base = levels.where("level = 0").select("image", F.floor(F.col("h") / factor).alias("target"))
    gap = F.abs(F.col("h") - F.col("target"))
    return levels.join(base, "image").groupBy("image").agg(F.min_by("level", F.struct(gap.alias("gap"), "level")).alias("level"))


def strip_windows(strips: DataFrame, width: int, chunk: int) -> DataFrame:
    """``(strip, y0, y1, x0, x1)``: the chunk windows that a strip ``(strip, first, last)`` touches, clipped to it."""
    rows = strips.where("last > first").withColumn("cy", F.explode(F.expr(f"sequence(first div {chunk}, (last - 1) div {chunk})"))).withColumn("cx", F.explode(F.expr(f"sequence(0L, {(width - 1) // chunk}L)")))
    return rows.select("strip", F.greatest("first", F.col("cy") * chunk).alias("y0"), F.least("last", (F.col("cy") + 1) * chunk).alias("y1"), (F.col("cx") * chunk).alias("x0"), F.least(F.lit(width), (F.col("cx") + 1) * chunk).cast("long").alias("x1"))


def tile_table(px: DataFrame, size: int) -> DataFrame:
    """``(channel, tile_y, tile_x, n, total, check)`` of pixels ``(channel, y, x, v)``: what a written tile is compared by."""
    place = (F.col("y") % size) * size + F.col("x") % size + 1
    return px.groupBy("channel", F.expr(f"y div {size}").alias("tile_y"), F.expr(f"x div {size}").alias("tile_x")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * place).alias("check"))


def pyramid(px: DataFrame, levels: int, size: int, keep: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Tiles of all levels ``(level, channel, tile_y, tile_x, n, total, check)``.

    Each level is halved from the one before and written before the next one
    reads it, so a lost executor repeats one level at most.
    """
    steps = Steps(px.sparkSession, "pyramid", keep_all=True)
    out = tile_table(px, size).withColumn("level", F.lit(0).cast("long"))
    for k in range(1, levels + 1):
        px = steps.save(block_mean(px, by=keep))
        out = out.unionByName(tile_table(px, size).withColumn("level", F.lit(k).cast("long")))
    return out


def levels_to_build(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(image, level, state)``: a level is kept if it and all before it are whole and marked done; from the first other one on all are rebuilt.

    The right size alone is no proof: a level of the right size without its mark is rebuilt.
    """
    rows = expected.join(by_sort(found.select("image", "level", F.col("h").alias("fh"), F.col("w").alias("fw"), "done")), ["image", "level"], "left")
    fits = F.coalesce((F.col("fh") == F.col("h")) & (F.col("fw") == F.col("w")) & F.col("done"), F.lit(False))
    first = rows.withColumn("fits", fits).groupBy("image").agg(F.min(F.when(~F.col("fits"), F.col("level"))).alias("first"))
    return rows.select("image", "level").join(by_sort(first), "image").select("image", "level", F.when(F.col("first").isNull() | (F.col("level") < F.col("first")), "kept").otherwise("rebuilt").alias("state"))


def resume_cycles(cycles: DataFrame, how: str = "hybrid", force_from: int | None = None) -> DataFrame:
    """``(sample, ord, cycle)`` to keep, of cycles ``(sample, ord, cycle, marked, written)`` in write order.

    ``manifest``: marked complete; ``pixels``: written; ``hybrid``: both.  Only a
    prefix of the order is kept, and nothing from ``force_from`` on.
    """
    ok = {"manifest": F.col("marked"), "pixels": F.col("written"), "hybrid": F.col("marked") & F.col("written")}[how]
    if force_from is not None:
        ok = ok & (F.col("cycle") != force_from)
    upto = Window.partitionBy("sample").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return cycles.withColumn("ok", F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(upto)).where("ok = 1").select("sample", "ord", "cycle")


def channel_counts(docs: DataFrame) -> DataFrame:
    """``(image, size_c)``: SizeC of the first Pixels of an OME-XML text; null if it has none."""
    got = F.xpath("xml", F.lit("//*[local-name()='Pixels']/@SizeC"))
    return docs.select("image", F.get(got, F.lit(0)).try_cast("long").alias("size_c"))


def physical_sizes(docs: DataFrame) -> DataFrame:
    """``(image, x, y, x_unit, y_unit)`` of OME-XML texts: sizes that are finite and above 0; a missing y unit is the x unit's, a missing x unit micrometres."""
    one = lambda name: F.get(F.xpath("xml", F.lit(f"//*[local-name()='Pixels']/@{name}")), F.lit(0))
    size = lambda name: F.when((one(name).try_cast("double") > 0) & (one(name).try_cast("double") < 1e300), one(name).try_cast("double"))
    unit = lambda name: F.nullif(F.trim(one(name)), F.lit(""))
    x_unit = F.coalesce(unit("PhysicalSizeXUnit"), F.lit("µm"))
    return docs.select("image", size("PhysicalSizeX").alias("x"), size("PhysicalSizeY").alias("y"), x_unit.alias("x_unit"), F.coalesce(unit("PhysicalSizeYUnit"), x_unit).alias("y_unit"))


def resolutions(sizes: DataFrame, factor, levels: int) -> DataFrame:
    """``(image, level, x_res, y_res)`` in pixels a centimetre, of sizes and a function of units to micrometres; both axes or none; level k has 2^k times larger pixels."""
    um = lambda a: F.col(a) * factor(F.col(f"{a}_unit"))
    rows = sizes.select("image", um("x").alias("ux"), um("y").alias("uy")).where("ux > 0 and uy > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    scale = F.expr("shiftleft(1L, level)")
    return rows.select("image", F.col("level").cast("long").alias("level"), F.round(10000.0 / F.col("ux") / scale, 6).alias("x_res"), F.round(10000.0 / F.col("uy") / scale, 6).alias("y_res"))


def canonical_axes(px: DataFrame) -> DataFrame:
    """Pixels ``(image, axes, i, j, k, v)`` of three axes in any order, as ``(image, channel, y, x, v)``."""
    at = lambda a: F.element_at(F.array("i", "j", "k"), F.instr("axes", F.lit(a)))
    return px.where("length(axes) = 3 and instr(axes, 'C') > 0 and instr(axes, 'Y') > 0 and instr(axes, 'X') > 0").select("image", at("C").alias("channel"), at("Y").alias("y"), at("X").alias("x"), "v")


def same_layout(stores: DataFrame, expected: DataFrame) -> DataFrame:
    """``(store, ok)``: whether shape, type and channel names of a store are those expected."""
    mine = F.struct("h", "w", "n_channels", "dtype", "names")
    want = expected.select("store", mine.alias("want"))
    return stores.select("store", mine.alias("have")).join(want, "store", "left").select("store", F.coalesce(F.col("have") == F.col("want"), F.lit(False)).alias("ok"))


def stride_quantiles(px: DataFrame, low: float, high: float, wanted: int, height: int, width: int, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Two exact percentiles of each channel over every s-th row and column, s so that about ``wanted`` pixels stay; finite values only.

    The stride is the feature: statistics of a channel from a regular sample.
    """
    stride = max(1, int((height * width / wanted) ** 0.5))
    rows = px.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    return rows.groupBy(*by).agg(F.round(F.percentile("v", F.lit(low)), 6).alias("lo"), F.round(F.percentile("v", F.lit(high)), 6).alias("hi"))


def contrast_limits(thumbs: DataFrame, top: int) -> DataFrame:
    """``(channel, lo, hi)``: percentiles 1 and 99 of a thumbnail, or the type's range where they do not differ."""
    limits = thumbs.groupBy("channel").agg(F.percentile("v", F.lit(0.01)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi"))
    flat = F.col("hi") <= F.col("lo")
    return limits.select("channel", F.round(F.when(flat, 0.0).otherwise(F.col("lo")), 6).alias("lo"), F.round(F.when(flat, float(top)).otherwise(F.col("hi")), 6).alias("hi"))


def scale_regions(regions: DataFrame, d: int) -> DataFrame:
    """Region rows ``(region, y0, y1, x0, x1, dy, dx, pixels)`` found at 1/d, at full size."""
    return regions.select("region", *[(F.col(c) * d).alias(c) for c in ("y0", "y1", "x0", "x1", "dy", "dx")], (F.col("pixels") * d * d).alias("pixels"))


def feature_count(sigmas: Column, flags: dict[str, Column]) -> Column:
    """Feature maps of a channel: one for intensity, and for each sigma one or, for tensors, two of each kind."""
    per = sum((F.when(flags[k], n).otherwise(0) for k, n in (("gaussian", 1), ("gradient", 1), ("log", 1), ("dog", 1), ("structure", 2), ("hessian", 2))), F.lit(0))
    return (F.when(flags["intensity"], 1).otherwise(0) + per * sigmas).cast("long")


def config_hash(*fields: str) -> Column:
    """The hash of a configuration: its fields as JSON, in the order given."""
    return F.sha1(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
