"""Neighbourhood operators on pixel tables, as spread-and-combine.

A pixel is sent to the places it bears on by one ``explode`` over a constant list
of offsets and met there by one aggregation: a single shuffle with map-side
combine, and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import by_sort

CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def disk(r: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]


def square(r: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]


def spread(px: DataFrame, offsets: list, height: int, width: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Each row at each offset inside the image; ``offsets`` may carry a weight, given as ``w``."""
    items = [F.struct((F.col("y") + o[0]).alias("y"), (F.col("x") + o[1]).alias("x"), *([F.lit(float(o[2])).alias("w")] if len(o) > 2 else [])) for o in offsets]
    keep = [c for c in px.columns if c not in ("y", "x")]
    out = px.select(*keep, F.explode(F.array(*items)).alias("_p")).select("_p.*", *keep)
    return out.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def dilate(mask: DataFrame, offsets: list, height: int, width: int) -> DataFrame:
    return spread(mask.select("y", "x"), offsets, height, width).distinct()


def erode(mask: DataFrame, offsets: list, height: int, width: int) -> DataFrame:
    """Places whose whole footprint lies in the mask; the outside of the image is not in it."""
    met = spread(mask.select("y", "x"), [(-a, -b) for a, b in offsets], height, width)
    return met.groupBy("y", "x").agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).select("y", "x")


def opened(mask: DataFrame, offsets: list, height: int, width: int) -> DataFrame:
    return dilate(erode(mask, offsets, height, width), offsets, height, width)


def closed(mask: DataFrame, offsets: list, height: int, width: int) -> DataFrame:
    """Erosion after dilation on a padded plane, so that the border does not eat the mask."""
    r = max(max(abs(a), abs(b)) for a, b in offsets)
    moved = mask.select((F.col("y") + r).alias("y"), (F.col("x") + r).alias("x"))
    grown = erode(dilate(moved, offsets, height + 2 * r, width + 2 * r), offsets, height + 2 * r, width + 2 * r)
    back = grown.select((F.col("y") - r).alias("y"), (F.col("x") - r).alias("x"))
    return back.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def window_max(px: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """``(y, x, vmax)``: the largest value of the square window, first along columns and then along rows."""
    line = range(-radius, radius + 1)
    tall = spread(px, [(k, 0) for k in line], height, width).groupBy("y", "x").agg(F.max("v").alias("v"))
    return spread(tall, [(0, k) for k in line], height, width).groupBy("y", "x").agg(F.max("v").alias("vmax"))


def local_peaks(px: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Pixels that equal the largest of their window."""
    return px.join(by_sort(window_max(px, radius, height, width)), ["y", "x"]).where(F.col("v") == F.col("vmax")).select("y", "x", "v")


def reflect(c: Column, n: int) -> Column:
    """Mirror a place across the edge, the edge pixel repeated; good for one image length."""
    return F.when(c < 0, -c - 1).when(c >= n, 2 * n - 1 - c).otherwise(c)


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    import math

    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k, x / sum(w)) for k, x in zip(range(-r, r + 1), w)]


def derivative_kernel(sigma: float, order: int, truncate: float = 4.0) -> list[tuple[int, float]]:
    """The sampled Gaussian times the polynomial of its first or second derivative; order 0 is the Gaussian."""
    s2 = sigma * sigma
    return [(k, w * (1.0, k / s2, (k * k / s2 - 1.0) / s2)[order]) for k, w in gaussian_kernel(sigma, truncate)]


def convolve_many(px: DataFrame, out: dict[str, list[tuple[str, list[tuple[int, float]]]]], axis: str, n: int) -> DataFrame:
    """One pass of several filters along an axis with mirrored edges; every pixel of the plane must be there.

    ``out``: by name, the (column, kernel) terms that are summed.  A pixel bears
    on the places that read it directly or through the mirror, so the sums meet
    at the reading place: one scan and one shuffle, however many filters.
    """
    other = "x" if axis == "y" else "y"
    terms = [(name, value, dict(kernel)) for name, parts in out.items() for value, kernel in parts]
    r = max(max(w) for _, _, w in terms)
    c = F.col(axis)

    def read(at: Column, k: int) -> Column:
        return F.struct(at.alias("at"), *[F.lit(w.get(k, 0.0)).alias(f"w{i}") for i, (_, _, w) in enumerate(terms)])

    reads = [read(c - k, k) for k in range(-r, r + 1)]
    reads += [read(-c - 1 - k, k) for k in range(-r, 0)] + [read(2 * n - 1 - c - k, k) for k in range(1, r + 1)]  # through the mirror at either end
    values = sorted({value for _, value, _ in terms})
    met = px.select(F.col(other), *values, F.explode(F.array(*reads)).alias("_r")).where(F.col("_r.at").between(0, n - 1))
    total = lambda name: sum((F.col(value) * F.col(f"_r.w{i}") for i, (of, value, _) in enumerate(terms) if of == name), F.lit(0.0))
    return met.groupBy(F.col("_r.at").alias(axis), other).agg(*[F.sum(total(name)).alias(name) for name in out])


def convolve(px: DataFrame, kernel: list[tuple[int, float]], axis: str, n: int, value: str = "v") -> DataFrame:
    """One pass of one separable filter."""
    return convolve_many(px, {"v": [(value, kernel)]}, axis, n)


def gaussian_derivatives(px: DataFrame, sigma: float, height: int, width: int, truncate: float = 4.0) -> DataFrame:
    """``(y, x, v, gy, gx, hyy, hyx, hxx)``: the smoothed plane, its slopes and its second derivatives.

    All are convolutions with derivatives of the Gaussian, edges mirrored, in two
    shuffles together.  The Laplacian is hyy + hxx.
    """
    k0, k1, k2 = (derivative_kernel(sigma, order, truncate) for order in range(3))
    down = convolve_many(px, {"d0": [("v", k0)], "d1": [("v", k1)], "d2": [("v", k2)]}, "y", height)
    return convolve_many(down, {"v": [("d0", k0)], "gy": [("d1", k0)], "gx": [("d0", k1)], "hyy": [("d2", k0)], "hyx": [("d1", k1)], "hxx": [("d0", k2)]}, "x", width)


def structure_tensor(px: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """``(y, x, ayy, ayx, axx)``: products of central differences, smoothed by a Gaussian; edges mirrored."""
    products = gradient(px, height, width).select("y", "x", (F.col("gy") * F.col("gy")).alias("ayy"), (F.col("gy") * F.col("gx")).alias("ayx"), (F.col("gx") * F.col("gx")).alias("axx"))
    k = gaussian_kernel(sigma)
    each = {name: [(name, k)] for name in ("ayy", "ayx", "axx")}
    return convolve_many(convolve_many(products, each, "y", height), each, "x", width)


def gaussian(px: DataFrame, sigma: float, height: int, width: int, truncate: float = 4.0) -> DataFrame:
    k = gaussian_kernel(sigma, truncate)
    return convolve(convolve(px, k, "y", height), k, "x", width)


def gradient(px: DataFrame, height: int, width: int) -> DataFrame:
    """Central differences with mirrored edges: ``(y, x, gy, gx)``."""
    at = lambda sy, sx: F.struct(F.lit(sy).alias("sy"), F.lit(sx).alias("sx"))
    reads = [(a, b, s, axis) for axis, (a, b) in (("gy", (1, 0)), ("gx", (0, 1))) for s in (1, -1)]
    items = []
    for a, b, s, axis in reads:
        y, x = F.col("y") - s * a, F.col("x") - s * b
        items.append(F.struct(y.alias("y"), x.alias("x"), F.lit(axis).alias("g"), F.lit(0.5 * s).alias("w")))
    # an edge pixel stands in for the one beyond it
    items += [
        F.struct(F.when(F.col("y") == 0, 0).otherwise(F.lit(-1)).alias("y"), F.col("x").alias("x"), F.lit("gy").alias("g"), F.lit(-0.5).alias("w")),
        F.struct(F.when(F.col("y") == height - 1, height - 1).otherwise(F.lit(-1)).alias("y"), F.col("x").alias("x"), F.lit("gy").alias("g"), F.lit(0.5).alias("w")),
        F.struct(F.col("y").alias("y"), F.when(F.col("x") == 0, 0).otherwise(F.lit(-1)).alias("x"), F.lit("gx").alias("g"), F.lit(-0.5).alias("w")),
        F.struct(F.col("y").alias("y"), F.when(F.col("x") == width - 1, width - 1).otherwise(F.lit(-1)).alias("x"), F.lit("gx").alias("g"), F.lit(0.5).alias("w")),
    ]
    met = px.select("v", F.explode(F.array(*items)).alias("_p")).select("v", "_p.*").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    part = lambda g: F.sum(F.when(F.col("g") == g, F.col("v") * F.col("w")).otherwise(F.lit(0.0))).alias(g)
    return met.groupBy("y", "x").agg(part("gy"), part("gx"))


def inner_boundary(labels: DataFrame, height: int, width: int) -> DataFrame:
    """Labelled pixels with a 4-neighbour inside the image of another label or none."""
    sides = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    met = spread(labels.select("y", "x", "label", F.lit(0).alias("own")).withColumn("own", F.lit(0)), sides, height, width)
    both = met.unionByName(labels.select("y", "x", "label", F.lit(1).alias("own")))
    inside = F.lit(4) - (F.col("y") == 0).cast("int") - (F.col("y") == height - 1).cast("int") - (F.col("x") == 0).cast("int") - (F.col("x") == width - 1).cast("int")
    own = F.max(F.when(F.col("own") == 1, F.col("label")))
    seen = both.groupBy("y", "x").agg(own.alias("label"), F.count(F.when(F.col("own") == 0, 1)).alias("n"), F.min(F.when(F.col("own") == 0, F.col("label"))).alias("low"), F.max(F.when(F.col("own") == 0, F.col("label"))).alias("high"))
    return seen.where(F.col("label").isNotNull() & ((F.col("n") < inside) | (F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))).select("y", "x", "label")


def distance_squared(mask: DataFrame, height: int, width: int, reach: int) -> DataFrame:
    """Squared distance of each mask pixel to the nearest pixel outside it, up to ``reach``; further ones are null.

    Two separable passes: along columns, then over the rows within reach.
    """
    out = mask.sparkSession.range(height).select(F.col("id").cast("long").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x")).join(mask.select("y", "x"), ["y", "x"], "left_anti")
    offsets = list(range(-reach, reach + 1))
    column = out.select("x", F.explode(F.array(*[F.struct((F.col("y") + k).alias("y"), F.lit(k * k).alias("d")) for k in offsets])).alias("p")).select("x", "p.*").groupBy("y", "x").agg(F.min("d").alias("d"))
    both = column.select("y", F.explode(F.array(*[F.struct((F.col("x") + k).alias("x"), (F.col("d") + k * k).alias("d")) for k in offsets])).alias("p")).select("y", "p.*").groupBy("y", "x").agg(F.min("d").alias("d2"))
    return mask.select("y", "x").join(both, ["y", "x"], "left").select("y", "x", F.when(F.col("d2") <= reach * reach, F.col("d2")).cast("long").alias("d2"))
