"""Label edits as relational operators over ``(y, x, label)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import by_sort
from .graph import components
from .islands import numbered
from .neighbourhood import CROSS, erode


def difference(base: DataFrame, edited: DataFrame) -> DataFrame:
    """Pixels whose label changed, 0 standing for none."""
    both = base.withColumnRenamed("label", "old").join(by_sort(edited.withColumnRenamed("label", "new")), ["y", "x"], "full")
    both = both.select("y", "x", F.coalesce("old", F.lit(0)).cast("long").alias("old"), F.coalesce("new", F.lit(0)).cast("long").alias("new"))
    return both.where("old <> new")


def merge_under(labels: DataFrame, line: DataFrame) -> DataFrame:
    """All labels that a mask touches become the smallest of them; fewer than two change nothing."""
    touched = labels.join(line.select("y", "x"), ["y", "x"], "left_semi").select(F.col("label").alias("hit")).distinct()
    low = touched.agg(F.min("hit").alias("low"), F.count("*").alias("n"))
    met = labels.join(touched, F.col("label") == F.col("hit"), "left").crossJoin(F.broadcast(low))
    return met.select("y", "x", F.when(F.col("hit").isNotNull() & (F.col("n") > 1), F.col("low")).otherwise(F.col("label")).alias("label"))


def delete_at(labels: DataFrame, y: int, x: int) -> DataFrame:
    gone = labels.where((F.col("y") == y) & (F.col("x") == x)).select("label").distinct()
    return labels.join(gone, "label", "left_anti").select("y", "x", "label")


def draw(labels: DataFrame, shape: DataFrame) -> DataFrame:
    """A drawn shape extends the label that it overlaps most onto the background, or is a new one."""
    over = labels.join(shape.select("y", "x"), ["y", "x"], "left_semi").groupBy("label").agg(F.count("*").alias("n"))
    best = over.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))
    top = labels.agg(F.coalesce(F.max("label"), F.lit(0).cast("long")).alias("top"))
    new = shape.select("y", "x").join(labels.select("y", "x"), ["y", "x"], "left_anti").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(top))
    return labels.select("y", "x", "label").unionByName(new.select("y", "x", F.coalesce("best", F.col("top") + 1).alias("label")))


def erase(labels: DataFrame, shape: DataFrame) -> DataFrame:
    return labels.join(shape.select("y", "x"), ["y", "x"], "left_anti").select("y", "x", "label")


def split_parts(labels: DataFrame, height: int, width: int, touched: DataFrame | None = None, least: int = 0, share: float = 0.0) -> DataFrame:
    """Give each separate part of a label an id of its own.

    The largest part (the first of equals) keeps the label; parts below
    ``max(least, share of the label)`` stay with it; the others get new ids above
    the largest one, by label and then size.  Components run on pixels keyed by
    label: only neighbours of one label join.
    """
    work = labels if touched is None else labels.join(touched.select("label").distinct(), "label", "left_semi")
    # Labels lie in planes of their own, far enough apart to have no common neighbours.
    planes = work.select((F.col("label") * (height + 2) + F.col("y")).alias("y"), "x")
    top = labels.agg(F.max("label").alias("m")).first()["m"] or 0
    parts = components(planes, (top + 1) * (height + 2), width)
    parts = parts.select(F.expr(f"y div {height + 2}").alias("label"), F.expr(f"y % {height + 2}").alias("y"), "x", F.col("label").alias("part"))
    size = parts.groupBy("label", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("label")
    ranked = size.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "part"))).withColumn("all", F.sum("n").over(own))
    fresh = (F.col("rank") > 1) & (F.col("n") >= F.greatest(F.lit(float(least)), F.col("all") * share))
    keyed = ranked.where(fresh).select("label", "part", F.struct("label", "rank").alias("key"))
    made = keyed.join(numbered(keyed, "key"), "key").select("label", "part", (F.lit(top) + F.col("number")).cast("long").alias("new"))
    out = parts.join(made, ["label", "part"], "left").select("y", "x", F.coalesce("new", "label").alias("label"))
    if touched is None:
        return out
    rest = labels.join(touched.select("label").distinct(), "label", "left_anti").select("y", "x", "label")
    return out.unionByName(rest)


def split_by_line(labels: DataFrame, line: DataFrame, height: int, width: int, least: int = 50, share: float = 0.01) -> DataFrame:
    """Cut labels along a line: its pixels are cleared where a label falls apart, and kept where it does not."""
    touched = labels.join(line.select("y", "x"), ["y", "x"], "left_semi").select("label").distinct()
    cut = erase(labels, line)
    parts = split_parts(cut, height, width, touched, least, share)
    kept = cut.join(parts.withColumnRenamed("label", "now"), ["y", "x"]).groupBy("label").agg(F.countDistinct("now").alias("n")).where("n = 1").select("label")
    back = labels.join(line.select("y", "x"), ["y", "x"], "left_semi").join(kept, "label", "left_semi").select("y", "x", "label")
    return parts.unionByName(back)


def erase_and_split(labels: DataFrame, shape: DataFrame, height: int, width: int) -> DataFrame:
    """Erase a shape; labels that it touched and that fell apart are split into their parts, whatever their size."""
    touched = labels.join(shape.select("y", "x"), ["y", "x"], "left_semi").select("label").distinct()
    return split_parts(erase(labels, shape), height, width, touched)


def erode_and_split(labels: DataFrame, label: int, times: int, height: int, width: int) -> DataFrame:
    """Erode one label ``times`` times by its four neighbours, then split it into the parts that are left."""
    own = labels.where(F.col("label") == label).select("y", "x")
    for _ in range(times):
        own = erode(own, CROSS, height, width)
    rest = labels.where(F.col("label") != label).select("y", "x", "label")
    changed = rest.unionByName(own.withColumn("label", F.lit(label).cast("long")))
    return split_parts(changed, height, width, labels.where(F.col("label") == label).select("label").distinct())


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot with changed pixels ``(y, x, new)``; 0 clears a pixel.  ``difference`` of the two gives the changes back."""
    kept = base.join(changes.select("y", "x"), ["y", "x"], "left_anti").select("y", "x", "label")
    return kept.unionByName(changes.where("new > 0").select("y", "x", F.col("new").alias("label")))


def model_needs(base: DataFrame, edited: DataFrame) -> DataFrame:
    """Which follow-up models an edit asks for: existing labels changed, or new labels appeared."""
    old = base.select("label").distinct().withColumn("known", F.lit(True))
    changed = difference(base, edited)
    first = changed.where("old > 0").select(F.lit(1).alias("k")).agg((F.count("*") > 0).alias("changed"))
    new = edited.select("label").distinct().join(old, "label", "left_anti").agg((F.count("*") > 0).alias("appeared"))
    return first.crossJoin(new)
