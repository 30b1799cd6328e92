"""Grids, resampling and placement of pixel tables ``(y, x, v)``.

Each operator is a projection, or one aggregation whose key is a function of the
pixel, so Spark combines on the map side before any shuffle; extra key columns
(image, channel, ...) are carried by ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_pixel


def tile_grid(spark: SparkSession, height: int, width: int, tile: int, stride: int | None = None, y0: int = 0, x0: int = 0) -> DataFrame:
    """``(tile_y, tile_x, y0, x0, h, w)``, clipped at the edge; a stride below the tile makes an overlapping lattice from its origin."""
    step = stride or tile
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(y0), F.lit(height - 1), F.lit(step))).alias("y0"))
    grid = rows.select("y0", F.explode(F.sequence(F.lit(x0), F.lit(width - 1), F.lit(step))).alias("x0"))
    return grid.select(F.expr(f"(y0 - {y0}) div {step}").alias("tile_y"), F.expr(f"(x0 - {x0}) div {step}").alias("tile_x"), "y0", "x0", F.least(F.lit(tile), height - F.col("y0")).alias("h"), F.least(F.lit(tile), width - F.col("x0")).alias("w"))


def on_lattice(px: DataFrame, tile: int, stride: int) -> DataFrame:
    """Each pixel with every lattice tile that covers it: ``ceil(tile / stride)`` squared rows at most, no join."""
    def covers(c: str) -> Column:
        first = F.greatest(F.ceil((F.col(c) - (tile - 1)) / stride), F.lit(0))
        return F.sequence(first.cast("int"), F.floor(F.col(c) / stride).cast("int"))

    return px.withColumn("tile_y", F.explode(covers("y"))).withColumn("tile_x", F.explode(covers("x")))


def tiles_by_focus(grid: DataFrame, fy: float, fx: float) -> DataFrame:
    """Squared distance of each tile's centre to a point, for ordering."""
    cy, cx = F.col("y0") + F.col("h") / 2.0, F.col("x0") + F.col("w") / 2.0
    return grid.withColumn("d2", (cy - fy) * (cy - fy) + (cx - fx) * (cx - fx))


def block_mean(px: DataFrame, factor: int = 2, bits: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each block of the pixels that are there, rounded half to even."""
    key = [F.expr(f"y div {factor}").alias("y"), F.expr(f"x div {factor}").alias("x")]
    return px.groupBy(*by, *key).agg(to_pixel(F.avg("v"), bits).alias("v"))


def block_mean_trimmed(px: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    """Mean of whole blocks; rows and columns past the last multiple are left out."""
    inside = px.where((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    return inside.groupBy(F.expr(f"y div {factor}").alias("y"), F.expr(f"x div {factor}").alias("x")).agg(F.avg("v").alias("mean"))


def block_sum(px: DataFrame, factor: int) -> DataFrame:
    """Sum of each block; what is missing counts as 0."""
    return px.groupBy(F.expr(f"y div {factor}").alias("y"), F.expr(f"x div {factor}").alias("x")).agg(F.sum("v").alias("total"))


def to_canvas(px: DataFrame, height: int, width: int, canvas_h: int, canvas_w: int) -> DataFrame:
    """Centre a plane on a canvas: padded by half the difference, rounded down, or cropped alike."""
    def move(c: str, n: int, m: int) -> Column:
        return F.col(c) + (m - n) // 2 if m >= n else F.col(c) - (n - m) // 2

    moved = px.withColumn("y", move("y", height, canvas_h)).withColumn("x", move("x", width, canvas_w))
    return moved.where(F.col("y").between(0, canvas_h - 1) & F.col("x").between(0, canvas_w - 1))


def roi(px: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """All pixels of a box, 0 where the image has none; the box filter reaches the scan."""
    cut = px.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    grid = tile_grid(px.sparkSession, y1, x1, 1, y0=y0, x0=x0).select(F.col("y0").cast("long").alias("y"), F.col("x0").cast("long").alias("x"))
    return grid.join(cut, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0).cast("long")).alias("v"))


def shift(px: DataFrame, dy: int, dx: int, height: int, width: int) -> DataFrame:
    """Move by whole pixels; what leaves the image is dropped, what is uncovered has no row."""
    moved = px.withColumn("y", F.col("y") + dy).withColumn("x", F.col("x") + dx)
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def shift_bilinear(px: DataFrame, dy: float, dx: float, height: int, width: int) -> DataFrame:
    """Move by parts of a pixel: each source pixel is spread over four by one map-side combined sum."""
    import math

    iy, ix = math.floor(dy), math.floor(dx)
    fy, fx = dy - iy, dx - ix
    parts = [(iy + a, ix + b, (fy if a else 1 - fy) * (fx if b else 1 - fx)) for a in (0, 1) for b in (0, 1)]
    spread = F.explode(F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x"), (F.col("v") * F.lit(w)).alias("v")) for a, b, w in parts if w]))
    out = px.select(spread.alias("p")).select("p.*").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return out.groupBy("y", "x").agg(F.sum("v").alias("v"))


def bounding_box(mask: DataFrame, height: int, width: int, pad: int = 0) -> DataFrame:
    """Half-open box of a mask, padded and clipped; the whole image for an empty mask."""
    low = lambda c: F.greatest(F.coalesce(F.min(c) - pad, F.lit(0)), F.lit(0)).cast("long")
    high = lambda c, n: F.least(F.coalesce(F.max(c) + 1 + pad, F.lit(n)), F.lit(n)).cast("long")
    return mask.agg(low("y").alias("y0"), high("y", height).alias("y1"), low("x").alias("x0"), high("x", width).alias("x1"))


def piecewise_field(labels: DataFrame, regions: DataFrame, dy: float, dx: float) -> DataFrame:
    """Each pixel's shift: its region's, else the global one.  Spark broadcasts the regions if they are small."""
    moved = labels.join(regions, "label", "left")
    return moved.select("y", "x", F.coalesce("shift_y", F.lit(dy)).alias("dy"), F.coalesce("shift_x", F.lit(dx)).alias("dx"))


def source_rows(field: DataFrame, strip: int, height: int, pad: int = 4) -> DataFrame:
    """Source rows that each strip of an inverse warp can read."""
    return field.groupBy(F.expr(f"y div {strip}").alias("strip")).agg(
        F.greatest(F.floor(F.min(F.col("y") - F.col("dy"))) - pad, F.lit(0)).cast("long").alias("row0"),
        F.least(F.ceil(F.max(F.col("y") - F.col("dy"))) + pad + 1, F.lit(height)).cast("long").alias("row1"),
    )


def upsample(labels: DataFrame, factor: int, oy: int, ox: int, height: int, width: int) -> DataFrame:
    """Nearest upsampling of a label table, placed at an offset and clipped."""
    grow = labels.withColumn("y", F.explode(F.sequence(F.col("y") * factor + oy, F.col("y") * factor + oy + factor - 1)))
    grow = grow.withColumn("x", F.explode(F.sequence(F.col("x") * factor + ox, F.col("x") * factor + ox + factor - 1)))
    return grow.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def draw_polyline(spark: SparkSession, points: list[tuple[int, int]], radius: int = 0) -> DataFrame:
    """Pixels of a polyline, sampled once for each step of its longer side, thickened by a disk."""
    def segment(ya: int, xa: int, yb: int, xb: int) -> Column:
        n = max(abs(yb - ya), abs(xb - xa), 1)
        at = lambda i: F.struct(F.rint(ya + (yb - ya) * i / n).cast("long").alias("y"), F.rint(xa + (xb - xa) * i / n).cast("long").alias("x"))
        return F.transform(F.sequence(F.lit(0), F.lit(n)), at)

    parts = [segment(*a, *b) for a, b in zip(points, points[1:])]
    line = spark.range(1).select(F.explode(F.concat(*parts)).alias("p")).select("p.*").distinct()
    if not radius:
        return line
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    return line.select(F.explode(F.array(*[F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in disk])).alias("p")).select("p.*").distinct()
