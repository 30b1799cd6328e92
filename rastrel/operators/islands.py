"""Islands, boxes, strips and points: interval joins as equal joins on grid cells, components of overlapping masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Steps


def island_cells(labels: DataFrame, size: int, share: float = 0.005) -> DataFrame:
    """``(label, y0, y1, x0, x1, n)``: cells of an island's bounding box of which more than ``share`` is the island's.

    Cells start at the corner of the box and end with it.
    """
    box = labels.groupBy("label").agg(F.min("y").alias("by"), F.max("y").alias("ey"), F.min("x").alias("bx"), F.max("x").alias("ex"))
    at = lambda c, b: F.col(b) + F.floor((F.col(c) - F.col(b)) / size) * size
    cells = labels.join(box, "label").groupBy("label", at("y", "by").alias("y0"), at("x", "bx").alias("x0"), "ey", "ex").agg(F.count("*").alias("n"))
    cells = cells.withColumn("y1", F.least(F.col("y0") + size, F.col("ey") + 1)).withColumn("x1", F.least(F.col("x0") + size, F.col("ex") + 1))
    return cells.where(F.col("n") > share * (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).select("label", "y0", "y1", "x0", "x1", "n")


def points_in_tiles(points: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Points ``(id, y, x)`` with the columns of their tile ``(tile_y, tile_x, ...)``; points without a tile have no row."""
    placed = points.withColumn("tile_y", F.floor(F.col("y") / size)).withColumn("tile_x", F.floor(F.col("x") / size))
    return placed.join(tiles, ["tile_y", "tile_x"])


def box_overlaps(boxes: DataFrame, cell: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of half-open boxes ``(id, y0, y1, x0, x1)`` that overlap.

    Boxes meet in the grid cells that they touch; the cell of a pair's common
    corner alone reports it, so no pair comes twice.
    """
    cells = boxes.where("y1 > y0 and x1 > x0").withColumn("cy", F.explode(F.expr(f"sequence(y0 div {cell}, (y1 - 1) div {cell})"))).withColumn("cx", F.explode(F.expr(f"sequence(x0 div {cell}, (x1 - 1) div {cell})")))
    other = cells.select("cy", "cx", *[F.col(c).alias(f"o_{c}") for c in ("id", "y0", "y1", "x0", "x1")])
    met = cells.join(other, ["cy", "cx"]).where("id < o_id and y0 < o_y1 and o_y0 < y1 and x0 < o_x1 and o_x0 < x1")
    return met.where(F.expr(f"greatest(y0, o_y0) div {cell} = cy and greatest(x0, o_x0) div {cell} = cx")).select(F.col("id").alias("a"), F.col("o_id").alias("b"))


def strips_of_tiles(tiles: DataFrame, strip: int) -> DataFrame:
    """``(strip, tile, first, last)``: the rows of each tile ``(tile, y, h)`` that fall into each strip of the canvas."""
    rows = tiles.where("h > 0 and y + h > 0").withColumn("strip", F.explode(F.expr(f"sequence(greatest(y, 0L) div {strip}, (y + h - 1) div {strip})")))
    return rows.select("strip", "tile", F.greatest("y", F.col("strip") * strip).alias("first"), F.least(F.col("y") + F.col("h"), (F.col("strip") + 1) * strip).alias("last"))


def mask_overlaps(masks: DataFrame) -> DataFrame:
    """``(a, b, n)``: pairs of masks ``(mask, y, x)`` with a common pixel, a < b.

    A pixel meets the masks that cover it: as many as tiles overlap there.
    """
    other = masks.select(F.col("mask").alias("b"), "y", "x")
    return masks.join(other, ["y", "x"]).where("mask < b").groupBy(F.col("mask").alias("a"), "b").agg(F.count("*").alias("n"))


def joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, comp)``: components of a graph by their smallest node; labels spread and jump, each round is written."""
    steps = Steps(nodes.sparkSession, "islands")
    both = edges.select("a", "b").union(edges.select("b", "a"))
    state = steps.save(nodes.select("node", F.col("node").alias("comp")))
    while True:
        heard = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("heard"))
        met = state.join(heard, F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", F.coalesce("heard", "comp")).alias("low"))
        far = state.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        state = steps.save(met.join(far, "low").select("node", F.least("low", "far").alias("comp"), F.col("comp").alias("was")))
        changed = not state.where("comp < was").isEmpty()
        state = state.select("node", "comp")
        if not changed:
            return state


def numbered(values: DataFrame, column: str) -> DataFrame:
    """The distinct values with dense numbers from 1, in their order, without one task for all of them.

    Values are dealt by range and written; numbers count on within a range from
    the sum of the ranges before it.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = values.select(column).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    rows = Steps(spark, "numbers").save(rows.select(column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return rows.join(F.broadcast(sizes.select("_part", "_low", before.alias("_before"))), "_part").select(column, (F.col("_before") + F.col("_seq") - F.col("_low") + 1).cast("long").alias("number"))


def islands(masks: DataFrame, least: int = 1) -> DataFrame:
    """``(mask, island)``: masks that reach each other by common pixels, numbered in the order of their first mask."""
    pairs = mask_overlaps(masks).where(F.col("n") >= least)
    comp = joined(masks.select(F.col("mask").alias("node")).distinct(), pairs)
    return comp.join(numbered(comp, "comp"), "comp").select(F.col("node").alias("mask"), F.col("number").alias("island"))


def worst(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of an order: a report, taken by tasks before it is merged."""
    return rows.orderBy(*order).limit(n)
