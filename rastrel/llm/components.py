"""Connected components of an edge table, without collecting edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, comp)`` for each end of ``edges(a, b)``: comp is the smallest node reachable.

    Minimum labels spread along edges and then jump along labels, so a chain of
    length d takes about log d rounds.  Each round is written to the shared
    folder; the round before it is deleted.  No edges: an empty table.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct()
    both = scratch.save(both, f"{name}-edges")
    labels = scratch.save(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("comp")), f"{name}-0")
    k = 0
    while True:
        heard = both.join(labels.select(F.col("node").alias("near"), "comp"), "near").groupBy("node").agg(F.min("comp").alias("heard"))
        step = labels.join(heard, "node").select("node", "comp", F.least("comp", "heard").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = step.join(jump, "low").select("node", F.least("low", "far").alias("new"), "comp")
        k += 1
        saved = scratch.save(new, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        changed = saved.where("new < comp").limit(1).count()
        labels = saved.select("node", F.col("new").alias("comp"))
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
