"""TIFF files as tables: headers, channel names and tiles.

Files are read whole through Spark's ``binaryFile`` source, so any store that
Spark reads will do, and parsed inside one Arrow map; headers alone need no
pixels.  Classic and big files, both byte orders, strips and tiles, planes with
no compression or zlib are understood; other files raise an error that names the
reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag numbers, and the struct code of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIP_AT, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 270, 273, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, PREDICTOR, SAMPLES, SAMPLE_FORMAT = 322, 323, 324, 325, 317, 277, 339
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, ZLIB, ZLIB_OLD = 1, 8, 32946


def pages(raw: bytes) -> list[dict]:
    """The directories of a file: tags by number, with the byte order under ``order``."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    kind = struct.unpack(order + "H", raw[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    at = struct.unpack(order + ("Q" if big else "I"), raw[8:16] if big else raw[4:8])[0]
    count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    out = []
    while at:
        head = struct.calcsize(count)
        n = struct.unpack(order + count, raw[at : at + head])[0]
        tags: dict = {"order": order}
        for k in range(n):
            p = at + head + entry * k
            tag, type_, size = struct.unpack(order + "HH" + word, raw[p : p + 4 + struct.calcsize(word)])
            if type_ not in TYPES:
                continue
            code = TYPES[type_]
            total = struct.calcsize("=" + code) * size
            inline = p + entry - struct.calcsize(word)
            start = inline if total <= struct.calcsize(word) else struct.unpack(order + word, raw[inline : p + entry])[0]
            body = raw[start : start + total]
            tags[tag] = body.rstrip(b"\0").decode("utf-8", "replace") if code == "s" else struct.unpack(order + str(size * len(code)) + code[0], body)
        out.append(tags)
        end = at + head + entry * n
        at = struct.unpack(order + word, raw[end : end + struct.calcsize(word)])[0]
    return out


def pixel_type(page: dict) -> np.dtype:
    form = {1: "u", 2: "i", 3: "f"}[page.get(SAMPLE_FORMAT, (1,))[0]]
    return np.dtype(f"{page['order']}{form}{page.get(BITS, (8,))[0] // 8}")


def tiles(raw: bytes, page: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(y0, x0, pixels)`` of a page's strips or tiles, clipped at the edge."""
    if page.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("interleaved channels are not supported")
    how = page.get(COMPRESSION, (NONE,))[0]
    if how not in (NONE, ZLIB, ZLIB_OLD):
        raise ValueError(f"compression {how} is not supported")
    width, height, kind = page[WIDTH][0], page[HEIGHT][0], pixel_type(page)
    if TILE_AT in page:
        w, h, starts, sizes = page[TILE_WIDTH][0], page[TILE_HEIGHT][0], page[TILE_AT], page[TILE_SIZE]
    else:
        w, h, starts, sizes = width, min(page.get(STRIP_ROWS, (height,))[0], height), page[STRIP_AT], page[STRIP_SIZE]
    across = -(-width // w)
    for k, (at, size) in enumerate(zip(starts, sizes)):
        y0, x0 = k // across * h, k % across * w
        body = raw[at : at + size] if how == NONE else zlib.decompress(raw[at : at + size])
        rows = h if TILE_AT in page else min(h, height - y0)
        block = np.frombuffer(body, kind, rows * w).reshape(rows, w)
        if page.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        yield y0, x0, block[: height - y0, : width - x0]


def write(planes: np.ndarray, names: list[str] | None = None, tile: int = 0, compress: bool = False) -> bytes:
    """A classic little-endian file of ``(channel, y, x)`` planes, one page each."""
    planes = np.ascontiguousarray(planes)
    if names:
        from xml.sax.saxutils import quoteattr

        text = f'<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image><Pixels SizeC="{len(names)}">' + "".join(f'<Channel ID="Channel:0:{k}" Name={quoteattr(n)}/>' for k, n in enumerate(names)) + "</Pixels></Image></OME>"
    form = {"u": 1, "i": 2, "f": 3}[planes.dtype.kind]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for c, plane in enumerate(planes):
        plane = plane.astype(plane.dtype.newbyteorder("<"))
        height, width = plane.shape
        blocks = [plane]
        if tile:
            wide = np.pad(plane, ((0, -height % tile), (0, -width % tile)))
            blocks = [wide[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        starts, sizes = [], []
        for b in blocks:
            body = b.tobytes()
            body = zlib.compress(body) if compress else body
            starts.append(len(out)), sizes.append(len(body))
            out += body + b"\0" * (len(body) % 2)
        tags = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [plane.dtype.itemsize * 8]), COMPRESSION: ("H", [ZLIB if compress else NONE]), SAMPLES: ("H", [1]), SAMPLE_FORMAT: ("H", [form])}
        tags |= {TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile]), TILE_AT: ("I", starts), TILE_SIZE: ("I", sizes)} if tile else {STRIP_AT: ("I", starts), STRIP_ROWS: ("I", [height]), STRIP_SIZE: ("I", sizes)}
        if names and c == 0:
            tags[DESCRIPTION] = ("s", text.encode() + b"\0")
        fields = []
        for tag, (code, values) in sorted(tags.items()):
            body = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
            kind = {"H": 3, "I": 4, "s": 2}[code]
            if len(body) > 4:
                place = struct.pack("<I", len(out))
                out += body + b"\0" * (len(body) % 2)
            else:
                place = body.ljust(4, b"\0")
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


HEADERS = "path string, page int, height long, width long, dtype string, is_tiled boolean, description string"
TILES = "path string, channel_idx int, y0 long, x0 long, h int, w int, px array<double>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page of each file, without decoding pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"path": p, "page": k, "height": t[HEIGHT][0], "width": t[WIDTH][0], "dtype": pixel_type(t).newbyteorder("=").name, "is_tiled": TILE_AT in t, "description": t.get(DESCRIPTION)}
                for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, t in enumerate(pages(raw))
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("page", pa.int32()), ("height", pa.int64()), ("width", pa.int64()), ("dtype", pa.string()), ("is_tiled", pa.bool_()), ("description", pa.string())]))

    return _files(spark, path).mapInArrow(run, HEADERS)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of every page; a page is a channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, page in enumerate(pages(raw)):
                    got = list(tiles(raw, page))
                    arrays = [pa.array([p] * len(got)), pa.array([k] * len(got), pa.int32()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].shape[0] for g in got], pa.int32()), pa.array([g[2].shape[1] for g in got], pa.int32()), pa.array([g[2].ravel().astype(float) for g in got], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "channel_idx", "y0", "x0", "h", "w", "px"])

    return _files(spark, path).mapInArrow(run, TILES)


def channel_names(spark: SparkSession, path: str) -> DataFrame:
    """``(path, channel_idx, name)``: from the description, else ``Channel i``."""
    heads = inspect(spark, path)
    text = heads.where("page = 0").select("path", F.when(F.col("description").startswith("<"), F.xpath("description", F.lit("//*[local-name()='Channel']/@Name"))).alias("names"))
    named = F.trim(F.get("names", F.col("page")))
    return heads.join(text, "path").select("path", F.col("page").alias("channel_idx"), F.when(F.length(named) > 0, named).otherwise(F.concat(F.lit("Channel "), F.col("page").cast("string"))).alias("name"))


def to_pixels(tiles_: DataFrame) -> DataFrame:
    """Long form ``(..., y, x, v)`` of a tile table."""
    keep = [c for c in tiles_.columns if c not in ("y0", "x0", "h", "w", "px")]
    rows = tiles_.select(*keep, "y0", "x0", "w", F.posexplode("px").alias("k", "v"))
    return rows.select(*keep, (F.col("y0") + F.expr("k div w")).alias("y"), (F.col("x0") + F.col("k") % F.col("w")).alias("x"), "v")


def to_tiles(pixels: DataFrame, tile: int, by: list[str]) -> DataFrame:
    """Tiles of a dense pixel table; a group is one tile, whatever the image."""
    key = [F.expr(f"y div {tile} * {tile}").alias("y0"), F.expr(f"x div {tile} * {tile}").alias("x0")]
    got = pixels.groupBy(*by, *key).agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    size = lambda c: (F.array_max(F.transform("p", lambda p: p[c])) - F.array_min(F.transform("p", lambda p: p[c])) + 1).cast("int")
    return got.select(*by, "y0", "x0", size("y").alias("h"), size("x").alias("w"), F.transform("p", lambda p: p["v"]).alias("px"))


def save_tiles(tiles_: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """Partitioned Parquet: a later read of one channel opens its folder alone."""
    tiles_.write.mode(mode).partitionBy(*by).parquet(path)
