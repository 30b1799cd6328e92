"""Iterative operators over pixels, tiles and their edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import by_sort
from ..scratch import Steps
from .islands import numbered
from .neighbourhood import spread


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``0 .. n - 1`` that each number is linked with by the pairs ``(a, b)``.

    Roots hang under smaller roots that they meet, all at once, and then every
    number jumps to its root; pairs inside one tree drop out.
    """
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def linked(pairs: DataFrame) -> DataFrame:
    """``(label, root)`` of every end of ``pairs(a, b)``: the smallest label that it is linked with.

    Minima spread along pairs and then jump, so rounds grow with the logarithm of
    the longest chain; each is written to the shared folder.
    """
    kept, rounds = Steps(pairs.sparkSession, "pairs", keep_all=True), Steps(pairs.sparkSession, "roots")
    both = kept.save(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    state = rounds.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("label"), F.least("a", "b").alias("root")))
    while True:
        heard = both.join(by_sort(state.select(F.col("label").alias("b"), "root")), "b").groupBy("a").agg(F.min("root").alias("heard"))
        met = state.join(by_sort(heard), F.col("label") == F.col("a")).select("label", F.col("root").alias("was"), F.least("root", "heard").alias("low"))
        far = state.select(F.col("label").alias("low"), F.col("root").alias("far"))
        new = rounds.save(met.join(by_sort(far), "low").select("label", F.least("low", "far").alias("root"), "was"))
        state = new.select("label", "root")
        if new.where("root < was").isEmpty():
            return state


def components(mask: DataFrame, height: int, width: int, diagonal: bool = False, block: int = 512) -> DataFrame:
    """``(y, x, label)``: connected components, each named by its smallest pixel number ``y * width + x``.

    Each block of ``block`` squared pixels is labelled by itself, a group of bounded
    size; pixels at the borders of blocks then meet those across in one equal join,
    and only the labels that they link go through rounds.  A label of a block has
    at most the block's pixels, so none is a hot key when they take their final
    name.  Repeated pixels count once; an empty mask gives an empty table.
    """
    sides = [(1, 0), (0, 1)] + ([(1, -1), (1, 1)] if diagonal else [])

    def run(table: pa.Table) -> pa.Table:
        n = np.unique(table.column("y").to_numpy() * width + table.column("x").to_numpy())
        y, x = n // width, n % width
        at = np.full((block + 1, block + 2), -1)
        ly, lx = y % block, x % block + 1
        at[ly, lx] = np.arange(len(n))
        ends = [at[ly + dy, lx + dx] for dy, dx in sides]
        a, b = (np.concatenate(e) for e in ([np.flatnonzero(e >= 0) for e in ends], [e[e >= 0] for e in ends]))
        edge = (ly == 0) | (ly == block - 1) | (lx == 1) | (lx == block)
        return pa.table({"y": y, "x": x, "label": n[local_roots(len(n), a, b)], "edge": edge})

    places = mask.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    blocks = places.groupBy(F.expr(f"y div {block}"), F.expr(f"x div {block}")).applyInArrow(run, "y long, x long, label long, edge boolean")
    found = Steps(mask.sparkSession, "components", keep_all=True).save(blocks)
    rim = found.where("edge")
    across = rim.select(F.col("label").alias("a"), F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in sides])).alias("p")).select("a", "p.*")
    pairs = across.join(by_sort(rim.select("y", "x", F.col("label").alias("b"))), ["y", "x"]).where("a <> b")
    return found.join(by_sort(linked(pairs)), "label", "left").select("y", "x", F.coalesce("root", "label").alias("label"))


def relabel(labels: DataFrame) -> DataFrame:
    """Labels 1..N in the order of the old ones; numbers are given to distinct labels, range by range, not to pixels."""
    return labels.join(by_sort(numbered(labels, "label")), "label").drop("label").withColumnRenamed("number", "label")


def drop_small(labels: DataFrame, least: int) -> DataFrame:
    big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labels.join(by_sort(big.select("label")), "label", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge ``(src, dst, dy, dx, w)`` and its reverse with the shift negated."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"), "w")
    return edges.select("src", "dst", "dy", "dx", "w").unionByName(back)


def voting(edges: DataFrame) -> DataFrame:
    """Edges fit to vote on positions."""
    return edges.where("not fallback and not isnan(dy) and not isnan(dx) and overlap > 0 and score >= 0.9 and fg_px >= 100 and fg_frac >= 0.02")


def relax(positions: DataFrame, edges: DataFrame, seed: int, rounds: int = 8, damping: float = 0.7, outlier: float = 12.0) -> DataFrame:
    """Jacobi sweeps: each tile moves towards the weighted mean of where its neighbours put it.

    With three or more votes, those further than ``outlier`` from their median
    are left out.  The seed stays at the origin.
    """
    links = both_ways(edges)
    steps = Steps(positions.sparkSession, "relax")
    for _ in range(rounds):
        votes = links.join(positions.withColumnRenamed("tile", "src"), "src").select(F.col("dst").alias("tile"), (F.col("y") + F.col("dy")).alias("vy"), (F.col("x") + F.col("dx")).alias("vx"), "w")
        middle = votes.groupBy("tile").agg(F.percentile("vy", F.lit(0.5)).alias("my"), F.percentile("vx", F.lit(0.5)).alias("mx"), F.count("*").alias("n"))
        kept = votes.join(middle, "tile").where((F.col("n") < 3) | (F.hypot(F.col("vy") - F.col("my"), F.col("vx") - F.col("mx")) <= outlier))
        target = kept.groupBy("tile").agg((F.sum(F.col("vy") * F.col("w")) / F.sum("w")).alias("ty"), (F.sum(F.col("vx") * F.col("w")) / F.sum("w")).alias("tx"))
        move = lambda c, t: F.when(F.col("tile") == seed, F.lit(0.0)).otherwise(F.col(c) + damping * (F.coalesce(F.col(t), F.col(c)) - F.col(c)))
        positions = positions.join(target, "tile", "left").select("tile", move("y", "ty").alias("y"), move("x", "tx").alias("x"))
        positions = steps.save(positions)
    return positions


def place_from_seed(tiles: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """``(tile, y, x, hop)``: breadth first over the edges; of several parents the smallest tile decides."""
    links = both_ways(edges)
    steps = Steps(tiles.sparkSession, "place")
    placed = steps.save(tiles.where(F.col("tile") == seed).select("tile", F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.lit(0).alias("hop")))
    hop = 0
    while True:
        edge = placed.where(F.col("hop") == hop).withColumnRenamed("tile", "src")
        new = links.join(edge, "src").select(F.col("dst").alias("tile"), "src", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
        new = new.groupBy("tile").agg(F.min_by(F.struct("y", "x"), F.struct("src", "y", "x")).alias("p")).join(placed.select("tile"), "tile", "left_anti")
        grown = steps.save(placed.unionByName(new.select("tile", "p.y", "p.x", F.lit(hop + 1).alias("hop"))))
        hop += 1
        if grown.where(F.col("hop") == hop).isEmpty():
            return grown
        placed = grown


def to_origin(positions: DataFrame) -> DataFrame:
    """Whole, non-negative positions; one row of minima is joined back."""
    low = positions.agg(F.min("y").alias("y0"), F.min("x").alias("x0"))
    return positions.crossJoin(F.broadcast(low)).select("tile", F.rint(F.col("y") - F.col("y0")).cast("long").alias("y"), F.rint(F.col("x") - F.col("x0")).cast("long").alias("x"))


def borrow_shifts(tiles: DataFrame, stride: float, limit: float, radius: float = 3.0) -> DataFrame:
    """Shifts of tiles ``(tile, island, cy, cx, dy, dx, gain, state)`` without their own, from seeds of the same island.

    Seeds are accepted or stable tiles.  Others take the mean of the seeds within
    ``radius`` strides (the larger of both axes), weighted by gain over distance,
    or the nearest seed's shift; none gives no shift.  The range join is an equal
    join on cells of the radius: a tile meets the seeds of nine cells, and only
    tiles without a seed there look through their island.
    """
    cell = radius * stride
    is_seed = F.col("state").isin("accepted", "stable_zero")
    seeds = tiles.where(is_seed).select("island", F.col("cy").alias("sy"), F.col("cx").alias("sx"), F.when(F.col("state") == "accepted", F.col("dy")).otherwise(F.lit(0.0)).alias("sdy"), F.when(F.col("state") == "accepted", F.col("dx")).otherwise(F.lit(0.0)).alias("sdx"), F.greatest("gain", F.lit(0.001)).alias("g"), F.floor(F.col("cy") / cell).alias("ky"), F.floor(F.col("cx") / cell).alias("kx"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    want = tiles.where(~is_seed).select("tile", "island", "cy", "cx")
    asked = want.withColumn("o", around).select("tile", "island", "cy", "cx", (F.floor(F.col("cy") / cell) + F.col("o.a")).alias("ky"), (F.floor(F.col("cx") / cell) + F.col("o.b")).alias("kx"))
    near = asked.join(seeds, ["island", "ky", "kx"]).where((F.abs(F.col("cy") - F.col("sy")) <= cell) & (F.abs(F.col("cx") - F.col("sx")) <= cell))
    w = F.col("g") / F.greatest(F.hypot(F.col("cy") - F.col("sy"), F.col("cx") - F.col("sx")), F.lit(1e-6))
    mean = near.groupBy("tile").agg((F.sum(F.col("sdy") * w) / F.sum(w)).alias("dy"), (F.sum(F.col("sdx") * w) / F.sum(w)).alias("dx"))
    far = want.join(mean.select("tile"), "tile", "left_anti").join(seeds.drop("ky", "kx"), "island")
    d2 = (F.col("cy") - F.col("sy")) * (F.col("cy") - F.col("sy")) + (F.col("cx") - F.col("sx")) * (F.col("cx") - F.col("sx"))
    nearest = far.groupBy("tile").agg(F.min_by(F.struct("sdy", "sdx"), F.struct(d2.alias("d"), F.col("sy"), F.col("sx"))).alias("s")).select("tile", F.col("s.sdy").alias("dy"), F.col("s.sdx").alias("dx"))
    out = want.select("tile").join(mean.unionByName(nearest), "tile", "left").select("tile", F.coalesce("dy", F.lit(0.0)).alias("dy"), F.coalesce("dx", F.lit(0.0)).alias("dx"))
    size = F.hypot("dy", "dx")
    scale = F.when(size > limit, limit / size).otherwise(F.lit(1.0))
    own = tiles.where(is_seed).select("tile", F.when(F.col("state") == "accepted", F.col("dy")).otherwise(F.lit(0.0)).alias("dy"), F.when(F.col("state") == "accepted", F.col("dx")).otherwise(F.lit(0.0)).alias("dx"), F.col("state").alias("mode"))
    return out.select("tile", (F.col("dy") * scale).alias("dy"), (F.col("dx") * scale).alias("dx"), F.lit("borrowed").alias("mode")).unionByName(own)


def smooth_prior(tiles: DataFrame, stride: float) -> DataFrame:
    """Mean shift of a tile and its neighbours of the island, weighted by gain over (distance in strides + 1) squared."""
    seeds = tiles.where(F.col("state").isin("accepted", "stable_zero"))
    held = seeds.select("island", F.col("cy").alias("sy"), F.col("cx").alias("sx"), F.when(F.col("state") == "accepted", F.col("dy")).otherwise(F.lit(0.0)).alias("sdy"), F.when(F.col("state") == "accepted", F.col("dx")).otherwise(F.lit(0.0)).alias("sdx"), F.when(F.col("state") == "accepted", F.greatest("gain", F.lit(0.001))).otherwise(F.greatest("gain", F.lit(0.25))).alias("g"), F.floor(F.col("cy") / stride).alias("ky"), F.floor(F.col("cx") / stride).alias("kx"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    asked = tiles.select("tile", "island", "cy", "cx", around.alias("o")).select("tile", "island", "cy", "cx", (F.floor(F.col("cy") / stride) + F.col("o.a")).alias("ky"), (F.floor(F.col("cx") / stride) + F.col("o.b")).alias("kx"))
    met = asked.join(held, ["island", "ky", "kx"]).where((F.abs(F.col("cy") - F.col("sy")) <= stride) & (F.abs(F.col("cx") - F.col("sx")) <= stride))
    d = F.hypot(F.col("cy") - F.col("sy"), F.col("cx") - F.col("sx")) / stride + 1.0
    w = F.col("g") / (d * d)
    return met.groupBy("tile").agg((F.sum(F.col("sdy") * w) / F.sum(w)).alias("dy"), (F.sum(F.col("sdx") * w) / F.sum(w)).alias("dx"))


def seam_jumps(tiles: DataFrame, stride: int) -> DataFrame:
    """Difference of shifts between each tile and its right and lower neighbour."""
    other = tiles.select(F.col("y0").alias("ny"), F.col("x0").alias("nx"), F.col("dy").alias("ndy"), F.col("dx").alias("ndx"))
    sides = F.explode(F.array(F.struct(F.lit("right").alias("side"), F.col("y0").alias("ny"), (F.col("x0") + stride).alias("nx")), F.struct(F.lit("down").alias("side"), (F.col("y0") + stride).alias("ny"), F.col("x0").alias("nx"))))
    return tiles.select("tile", "dy", "dx", sides.alias("s")).select("tile", "dy", "dx", "s.*").join(other, ["ny", "nx"]).select("tile", "side", F.hypot(F.col("dy") - F.col("ndy"), F.col("dx") - F.col("ndx")).alias("jump"))


def farthest_cells(cells: DataFrame, n: int) -> DataFrame:
    """``n`` cells spread out: the one nearest the mean, then again and again the one farthest from those chosen.

    Each round is one aggregation to one row; ties go to the smallest (y, x).
    """
    spark = cells.sparkSession
    mean = cells.agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
    d = (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")) + (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))
    first = cells.crossJoin(F.broadcast(mean)).agg(F.min_by(F.struct("y", "x"), F.struct(F.round(d, 6), "y", "x")).alias("c")).select("c.*").first()
    chosen = [] if first is None or first["y"] is None else [(first["y"], first["x"])]
    while chosen and len(chosen) < n:
        near = F.least(*[(F.col("y") - y) * (F.col("y") - y) + (F.col("x") - x) * (F.col("x") - x) for y, x in chosen], F.lit(1 << 60).cast("long"))
        best = cells.select("y", "x", near.alias("d")).where("d > 0").agg(F.min_by(F.struct("y", "x"), F.struct(-F.col("d"), "y", "x")).alias("c")).select("c.*").first()
        if best["y"] is None:
            break
        chosen.append((best["y"], best["x"]))
    return spark.createDataFrame([(k, y, x) for k, (y, x) in enumerate(chosen)], "rank long, y long, x long")
