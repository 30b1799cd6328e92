"""Thresholds, correlations and statistics over pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import moments_correlation


def with_limits(px: DataFrame, low: float, high: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Every row with two exact percentiles of its group; one row of statistics for each group is joined back."""
    stats = px.groupBy(*by).agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"))
    return px.join(stats, list(by)) if by else px.crossJoin(F.broadcast(stats))  # one row


def otsu(px: DataFrame, bins: int = 256) -> DataFrame:
    """The threshold that parts the histogram with the largest variance between classes: ``(bin, threshold)``.

    The histogram has at most ``bins`` rows, so its windows are small at any scale.
    """
    span = px.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")).cast("double") / float(bins)
    place = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("long")
    hist = px.crossJoin(F.broadcast(span)).where("hi > lo").groupBy(place.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    hist = hist.withColumn("centre", centre)
    upto, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w0, s0 = F.sum("n").over(upto).cast("double"), F.sum(F.col("n") * F.col("centre")).over(upto)
    w, s = F.sum("n").over(all_).cast("double"), F.sum(F.col("n") * F.col("centre")).over(all_)
    parts = hist.select("bin", "centre", w0.alias("w0"), s0.alias("s0"), w.alias("w"), s.alias("s")).where("w > w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    scored = parts.withColumn("score", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap, 3))
    return scored.orderBy(F.desc("score"), "bin").limit(1).select("bin", F.col("centre").alias("threshold"))


def correlation_sums(pairs: DataFrame, a: str = "a", b: str = "b") -> list[Column]:
    """Six sums that add up over any parts of the plane."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    return [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]


def correlation(pairs: DataFrame, by: list[Column], least: int) -> DataFrame:
    sums = pairs.groupBy(*by).agg(*correlation_sums(pairs))
    return sums.withColumn("corr", moments_correlation(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")), least=least))


def best_shift(fixed: DataFrame, moving: DataFrame, radius: int, least: int, height: int, width: int) -> DataFrame:
    """Correlation of every whole shift within a radius: one join on the shifted place, sums combined by shift."""
    shifts = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)])
    moved = moving.select("y", "x", F.col("v").alias("b"), F.explode(shifts).alias("s")).select((F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "b", "s.dy", "s.dx")
    return correlation(fixed.withColumnRenamed("v", "a").join(moved, ["y", "x"]), [F.col("dy"), F.col("dx")], least)


def weighted_mean(parts: DataFrame, key: list[str], values: list[str], weight: str, least: float = 1e-5) -> DataFrame:
    """Normalised overlap of weighted fields; places with hardly any weight have no row."""
    sums = parts.groupBy(*key).agg(F.sum(weight).alias("_w"), *[F.sum(F.col(v) * F.col(weight)).alias(v) for v in values]).where(F.col("_w") > least)
    return sums.select(*key, *[(F.col(v) / F.col("_w")).alias(v) for v in values])


def label_statistics(labels: DataFrame, planes: DataFrame) -> DataFrame:
    """Marker statistics of each label in each channel: the labels meet the planes on the pixel, then one aggregation."""
    met = planes.join(labels, ["y", "x"])
    return met.groupBy("label", "channel").agg(
        F.count("*").alias("area"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    )


def mode(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals; counts combine before the choice."""
    counted = rows.groupBy(*key, value).agg(F.count("*").alias("_n"))
    best = F.max_by(F.struct(F.col(value).alias("value"), F.col("_n").alias("n")), F.struct("_n", -F.col(value)))
    return counted.groupBy(*key).agg(best.alias("_b")).select(*key, F.col("_b.value").alias(value), F.col("_b.n").alias("n"))


def plane_health(px: DataFrame, by: list[str]) -> DataFrame:
    """Whether each plane has data: a value that is not 0, and more than one value."""
    seen = px.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max((F.col("v") != 0).cast("int")).alias("any"))
    kind = F.when(F.col("any") == 0, "all_zero").when(F.col("hi") - F.col("lo") <= 1, "constant").otherwise("ok")
    return seen.withColumn("state", kind).withColumn("written", (F.col("any") == 1) & (F.col("lo") != F.col("hi")))
