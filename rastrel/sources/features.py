"""A store of pixel features by tile, content-addressed, so that only what is not there is computed.

Rows ``(ty, tx, h, w, data)`` lie in folders by image, recipe and channel:
``data`` has the ``MAPS`` of one scale as float16 ``[map, y, x]``.  The recipe is
a hash of everything that the values depend on (scale, tile side, limits, version
of the rules), so a changed scale finds its own folder empty and all others
filled, and nothing stale can be read.  Features are those of the tile alone,
edges mirrored, as in ``learning.feature_stack`` over one tile.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbourhood import derivative_kernel
from .levels import _path

#: Maps of one scale, in the order of ``data``.
MAPS = ("g", "grad", "log", "dog", "st_big", "st_small", "he_big", "he_small")
VERSION = 1
#: Pieces that the points of a tile are packed in.
PIECES = 64
ROW = "image string, recipe string, channel int, ty long, tx long, h int, w int, data binary"
KEY = ["recipe", "channel", "ty", "tx"]


@dataclass(frozen=True)
class Recipe:
    """Scales, the side of tiles, and limits ``(low, high)`` between which values are stretched to 0 and 1 first, by channel; a channel without limits keeps its values."""

    sigmas: tuple[float, ...]
    size: int = 512
    limits: tuple[tuple[int, float, float], ...] = ()

    def key(self, sigma: float, channel: int) -> str:
        told = [VERSION, MAPS, float(sigma), self.size, [list(x[1:]) for x in self.limits if x[0] == channel]]
        return hashlib.sha256(json.dumps(told).encode()).hexdigest()[:32]


def convolved(plane: np.ndarray, sigma: float, down: int, across: int) -> np.ndarray:
    """The plane under derivatives of the Gaussian of these orders, edges mirrored as often as the kernel needs."""
    for axis, order in ((0, down), (1, across)):
        kernel = np.array([w for _, w in derivative_kernel(sigma, order)])
        r = len(kernel) // 2
        wide = np.pad(plane, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        n = plane.shape[axis]
        plane = sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(kernel[::-1]))
    return plane


def _eigenvalues(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larger and smaller one of ``[[a, b], [b, c]]``."""
    mean, half = (a + c) / 2, np.hypot((a - c) / 2, b)
    return mean + half, mean - half


def maps(plane: np.ndarray, sigma: float) -> np.ndarray:
    """``MAPS`` of one tile at one scale."""
    at = {(i, j): convolved(plane, sigma, i, j) for i, j in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))}
    wide = np.pad(plane, 1, mode="edge")
    gy, gx = (wide[2:, 1:-1] - wide[:-2, 1:-1]) / 2, (wide[1:-1, 2:] - wide[1:-1, :-2]) / 2
    st = _eigenvalues(*(convolved(p, sigma, 0, 0) for p in (gy * gy, gy * gx, gx * gx)))
    he = _eigenvalues(at[2, 0], at[1, 1], at[0, 2])
    return np.stack([at[0, 0], np.hypot(at[1, 0], at[0, 1]), at[2, 0] + at[0, 2], at[0, 0] - convolved(plane, 1.6 * sigma, 0, 0), *st, *he])


def as_half(values: np.ndarray) -> np.ndarray:
    """float16, held within its largest values: raw squares of slopes can be above them."""
    most = float(np.finfo(np.float16).max)
    return np.clip(values, -most, most).astype("<f2")


class FeatureStore:
    """The store below ``path``; one writer at a time for an image."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self) -> DataFrame:
        fs, p = _path(self.spark, self.path)
        there = bool(fs.exists(p)) and len(fs.listStatus(p)) > 0
        return self.spark.read.schema(ROW).parquet(self.path) if there else self.spark.createDataFrame([], ROW)

    def missing(self, tiles: DataFrame, image: str, recipe: Recipe) -> DataFrame:
        """``(recipe, channel, ty, tx, sigma)`` of tiles ``(channel, y0, x0, ...)`` that are not in the store: keys only, no pixel or feature is read."""
        channels = [r[0] for r in tiles.select("channel").distinct().collect()]  # as many as the image has
        asked = self.spark.createDataFrame([(c, recipe.key(s, c), s) for c in channels for s in recipe.sigmas], "channel int, recipe string, sigma double")
        wanted = tiles.select(F.col("channel").cast("int").alias("channel"), *_place(recipe)).join(F.broadcast(asked), "channel")
        have = self._rows().where((F.col("image") == image) & F.col("recipe").isin([r[0] for r in asked.select("recipe").distinct().collect()])).select(*KEY)
        return wanted.join(have, KEY, "left_anti").select(*KEY, "sigma")

    def fill(self, tiles: DataFrame, image: str, recipe: Recipe) -> int:
        """Compute and append what is missing of the tiles ``(channel, y0, x0, h, w, dtype, px)`` of an image; how many features of tiles that were.

        Tiles have to lie on the recipe's grid.  Those that are whole in the store
        are not sent to Python.  An append counts once its job is committed.
        """
        missing = self.missing(tiles, image, recipe)
        lacking = missing.groupBy("channel", "ty", "tx").agg(F.collect_list(F.struct("recipe", "sigma")).alias("todo"))
        own = tiles.select(F.col("channel").cast("int").alias("channel"), *_place(recipe), "y0", "x0", "h", "w", "dtype", "px").join(lacking, ["channel", "ty", "tx"])
        limits, size = {c: (low, high) for c, low, high in recipe.limits}, recipe.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["y0"] % size or r["x0"] % size or max(r["h"], r["w"]) > size:
                        raise ValueError(f"tile at {r['y0']}, {r['x0']} is not one of the grid of {size}")
                    plane = np.frombuffer(r["px"], np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["h"], r["w"]).astype(float)
                    if r["channel"] in limits:
                        low, high = limits[r["channel"]]
                        plane = np.clip((plane - low) / max(high - low, 1e-6), 0.0, 1.0)
                    rows = [{"recipe": t["recipe"], **{k: r[k] for k in ("channel", "ty", "tx", "h", "w")}, "data": as_half(maps(plane, t["sigma"])).tobytes()} for t in r["todo"]]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("recipe", pa.string()), ("channel", pa.int32()), ("ty", pa.int64()), ("tx", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))

        made = own.mapInArrow(run, ROW.removeprefix("image string, ")).select(F.lit(image).alias("image"), "*")
        before = self.count(image)
        made.write.mode("append").partitionBy("image", "recipe", "channel").parquet(self.path)
        return self.count(image) - before

    def count(self, image: str) -> int:
        return self._rows().where(F.col("image") == image).count()

    def read(self, image: str, recipe: Recipe, channel: int, sigma: float) -> DataFrame:
        """``(ty, tx, h, w, data)`` of one channel and scale: only its folder is listed for reading."""
        return self._rows().where((F.col("image") == image) & (F.col("recipe") == recipe.key(sigma, channel)) & (F.col("channel") == channel)).select("ty", "tx", "h", "w", "data")

    def at(self, points: DataFrame, image: str, recipe: Recipe, channel: int) -> DataFrame:
        """Points ``(y, x, ...)`` with an array ``f<k>`` of ``MAPS`` for each scale; a point whose tile is not in the store is left out.

        A tile is joined once with the points inside it: points are packed by
        tile in up to ``PIECES`` pieces, so a crowded tile is several rows.
        """
        out = points
        schema = "y long, x long, f array<double>"
        for k, sigma in enumerate(recipe.sigmas):
            place = [F.expr(f"cast(y div {recipe.size} as long)").alias("ty"), F.expr(f"cast(x div {recipe.size} as long)").alias("tx")]
            packed = points.select("y", "x").distinct().groupBy(*place, (F.pmod(F.xxhash64("y", "x"), F.lit(PIECES))).alias("_piece")).agg(F.collect_list(F.struct("y", "x")).alias("p"))

            def pick(batches: Iterator[pa.RecordBatch], size=recipe.size) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for r in batch.to_pylist():
                        data = np.frombuffer(r["data"], "<f2").reshape(len(MAPS), r["h"], r["w"])
                        inside = [p for p in r["p"] if p["y"] - r["ty"] * size < r["h"] and p["x"] - r["tx"] * size < r["w"]]
                        f = [data[:, p["y"] - r["ty"] * size, p["x"] - r["tx"] * size].astype(float).tolist() for p in inside]
                        yield pa.RecordBatch.from_pydict({"y": [p["y"] for p in inside], "x": [p["x"] for p in inside], "f": f}, pa.schema([("y", pa.int64()), ("x", pa.int64()), ("f", pa.list_(pa.float64()))]))

            got = packed.join(self.read(image, recipe, channel, sigma), ["ty", "tx"]).mapInArrow(pick, schema)
            out = out.join(got.withColumnRenamed("f", f"f{k}"), ["y", "x"])
        return out

    def drop(self, image: str, recipe: str | None = None, channel: int | None = None) -> bool:
        """Delete what the store has of an image, of one of its recipes, or of one channel of that; whether there was any."""
        parts = [f"image={image}"] + ([f"recipe={recipe}"] if recipe else []) + ([f"channel={channel}"] if recipe and channel is not None else [])
        fs, p = _path(self.spark, "/".join([self.path, *parts]))
        return bool(fs.delete(p, True))


def _place(recipe: Recipe) -> list:
    return [F.expr(f"cast(y0 div {recipe.size} as long)").alias("ty"), F.expr(f"cast(x0 div {recipe.size} as long)").alias("tx")]


def image_key(tiles: DataFrame) -> str:
    """The key of an image by its pixels: an order-free sum of hashes of its tiles, so that equal images share their features wherever they lie."""
    h = F.xxhash64("channel", "y0", "x0", "h", "w", "dtype", "px")
    r = tiles.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.bit_xor(h).alias("b")).first()
    return hashlib.sha256(f"{r['n']} {r['a']} {r['b']}".encode()).hexdigest()[:32]
