"""Tiled TIFF files as a Spark data source, read and written by byte range.

``register(spark)`` adds the format ``rastrel_tiff``.

* **Reading.**  The driver reads directories only.  A partition is a run of tiles
  of one page; the task reads that part of the page's offset table and then the
  bytes of its tiles, nothing else.  Filters on ``channel``, ``level``, ``y0`` and
  ``x0`` are pushed down: what they exclude is never read.  Classic and big files,
  both byte orders, strips and tiles, interleaved and separate samples, no
  compression or zlib, integer predictor.  Levels are the SubIFDs of a page.
  Samples keep their type: ``px`` has the little-endian bytes, ``dtype`` its name.
* **Writing.**  Tiles are not compressed, so the place of every tile of every
  level follows from the shape (``Layout``) before anything is written.  The
  driver lays out a draft with its directories; tasks write disjoint ranges of it,
  and a task that runs again writes the same bytes to the same place.  A level
  counts as written once the commit has put it in the journal, which is replaced
  by renaming; ``finish`` renames the draft.  The store must allow writing inside a
  file (POSIX: local, NFS, Lustre).
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from . import tiff as T

FORMAT = "rastrel_tiff"
SUB_IFDS, PLANAR = 330, 284
TILE = "path string, channel int, level int, y0 long, x0 long, h int, w int, dtype string, px binary"
ARROW = pa.schema([("path", pa.string()), ("channel", pa.int32()), ("level", pa.int32()), ("y0", pa.int64()), ("x0", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("dtype", pa.string()), ("px", pa.binary())])
#: Bytes of tiles that one partition reads.
PARTITION_BYTES = 32 << 20
FORMS = {"u": 1, "i": 2, "f": 3}


# ---------------------------------------------------------------- files


def _store(path: str):
    from pyarrow import fs

    where = path.replace("s3a://", "s3://") if "://" in path else path.removeprefix("file:")
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: this store cannot be written inside a file")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class Ranges:
    """A file that is read by byte range."""

    def __init__(self, path: str):
        store, where = _store(path)
        self.file, self.bytes_read = store.open_input_file(where), 0

    def read(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self.file.read_at(size, at)

    def close(self) -> None:
        self.file.close()


def files(path: str) -> list[str]:
    """The file, or the TIFF files below the folder, by name."""
    from pyarrow import fs

    store, where = _store(path)
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    if store.get_file_info(where).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and ".tif" in f.base_name.lower())


@dataclass
class Page:
    """A directory: short values, and of long ones their type, number and place."""

    order: str
    values: dict = field(default_factory=dict)
    far: dict = field(default_factory=dict)
    levels: list[Page] = field(default_factory=list)

    def one(self, tag: int, default: int | None = None) -> int:
        return self.values[tag][0] if tag in self.values else default

    def part(self, source: Ranges, tag: int, first: int, last: int) -> list[int]:
        """Values ``first`` to ``last`` of a table, by one ranged read."""
        if tag in self.values:
            return list(self.values[tag][first:last])
        code, _, at = self.far[tag]
        size = struct.calcsize("=" + code)
        return list(struct.unpack(f"{self.order}{last - first}{code}", source.read(at + first * size, (last - first) * size)))

    def text(self, source: Ranges, tag: int) -> str | None:
        if tag in self.values:
            return self.values[tag]
        if tag not in self.far:
            return None
        _, size, at = self.far[tag]
        return source.read(at, size).rstrip(b"\0").decode("utf-8", "replace")

    @property
    def dtype(self) -> np.dtype:
        form = {1: "u", 2: "i", 3: "f"}[self.one(T.SAMPLE_FORMAT, 1)]
        return np.dtype(f"{self.order}{form}{self.one(T.BITS, 8) // 8}")

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(T.HEIGHT), self.one(T.WIDTH)

    @property
    def block(self) -> tuple[int, int]:
        if T.TILE_WIDTH in self.values:
            return self.one(T.TILE_HEIGHT), self.one(T.TILE_WIDTH)
        return min(self.one(T.STRIP_ROWS, self.shape[0]), self.shape[0]), self.shape[1]

    @property
    def grid(self) -> tuple[int, int]:
        return tuple(-(-n // b) for n, b in zip(self.shape, self.block))

    @property
    def samples(self) -> int:
        return self.one(T.SAMPLES, 1)

    @property
    def separate(self) -> bool:
        return self.one(PLANAR, 1) == 2


def directories(source: Ranges) -> list[Page]:
    """The pages of a file with their levels; tables of more than 16 values stay in the file."""
    head = source.read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    wide = struct.calcsize(word)

    def directory(at: int) -> tuple[Page, int]:
        first = struct.calcsize(count)
        (n,) = struct.unpack(order + count, source.read(at, first))
        body = source.read(at + first, n * entry + wide)
        page = Page(order)
        for k in range(n):
            row = body[k * entry : (k + 1) * entry]
            tag, type_, size = struct.unpack(order + "HH" + word, row[: 4 + wide])
            code = T.TYPES.get(type_)
            if code is None:
                continue
            total, inline = struct.calcsize("=" + code) * size, row[4 + wide :]
            where = struct.unpack(order + word, inline)[0]
            if total > wide and (size > 16 or code == "s"):
                page.far[tag] = (code, size, where)
                continue
            raw = inline[:total] if total <= wide else source.read(where, total)
            page.values[tag] = raw.rstrip(b"\0").decode("utf-8", "replace") if code == "s" else struct.unpack(f"{order}{size * len(code)}{code[0]}", raw)
        return page, struct.unpack(order + word, body[n * entry :])[0]

    at, out = struct.unpack(order + word, head[8:16] if big else head[4:8])[0], []
    while at:
        page, at = directory(at)
        subs = page.values.get(SUB_IFDS) or (page.part(source, SUB_IFDS, 0, page.far[SUB_IFDS][1]) if SUB_IFDS in page.far else ())
        page.levels = [page, *(directory(sub)[0] for sub in subs)]
        out.append(page)
    return out


def channel_names(source: Ranges, pages: list[Page]) -> list[str]:
    """A name for each channel from the description of the first page; blank or missing ones are ``Channel i``, and so are all if none has one."""
    from xml.etree import ElementTree

    n = sum(p.samples for p in pages)
    try:
        tree = ElementTree.fromstring(pages[0].text(source, T.DESCRIPTION) or "")
        found = [(e.get("Name") or "").strip() for e in tree.iter() if e.tag.rpartition("}")[2] == "Channel"][:n]
    except ElementTree.ParseError:
        found = []
    return [name or f"Channel {k}" for k, name in enumerate([*found, *[""] * (n - len(found))])]


# ---------------------------------------------------------------- reading


@dataclass
class Tiles(InputPartition):
    """Tiles ``first`` to ``last`` of one level of a page, by row of its grid."""

    path: str
    page: Page
    channel: int
    level: int
    first: int
    last: int
    wanted: tuple[int, ...]  # samples

    def __post_init__(self):
        self.value = None


def decode(raw: bytes, page: Page, rows: int) -> np.ndarray:
    """``[row, column, sample]`` of one block of ``rows`` rows, little-endian."""
    how = page.one(T.COMPRESSION, T.NONE)
    if how not in (T.NONE, T.ZLIB, T.ZLIB_OLD):
        raise ValueError(f"compression {how} is not supported")
    raw = zlib.decompress(raw) if how != T.NONE else raw
    inside = 1 if page.separate else page.samples
    block = np.frombuffer(raw, page.dtype, rows * page.block[1] * inside).reshape(rows, page.block[1], inside)
    block = block.astype(page.dtype.newbyteorder("<"))
    return np.cumsum(block, axis=1, dtype=block.dtype) if page.one(T.PREDICTOR, 1) == 2 else block


def read_run(part: Tiles, keep, source: Ranges | None = None) -> Iterator[pa.RecordBatch]:
    """The tiles of a partition that ``keep(y0, x0)`` wants; tiles that lie side by side in the file are one read."""
    own = source or Ranges(part.path)
    page, (height, width), (h, w) = part.page, part.page.shape, part.page.block
    across, tiled = page.grid[1], T.TILE_WIDTH in page.values
    table = (T.TILE_AT, T.TILE_SIZE) if tiled else (T.STRIP_AT, T.STRIP_SIZE)
    plane = page.grid[0] * across
    for turn in sorted({s if page.separate else 0 for s in part.wanted}):
        places = [k for k in range(part.first, part.last) if keep(k // across * h, k % across * w)]
        if not places:
            continue
        low, high = places[0], places[-1] + 1
        at, size = (dict(zip(range(low, high), page.part(own, t, turn * plane + low, turn * plane + high))) for t in table)
        run: list[int] = []
        for k in [*places, None]:
            if run and (k is None or at[k] != at[run[-1]] + size[run[-1]] or at[k] + size[k] - at[run[0]] > PARTITION_BYTES):
                raw, rows = own.read(at[run[0]], sum(size[i] for i in run)), []
                for i in run:
                    y0, x0 = i // across * h, i % across * w
                    body = raw[at[i] - at[run[0]] :][: size[i]]
                    block = decode(body, page, h if tiled else min(h, height - y0))[: height - y0, : width - x0]
                    for s in part.wanted if not page.separate else (turn,):
                        one = block[:, :, 0 if page.separate else s]
                        rows.append((part.path, part.channel + s, part.level, y0, x0, *one.shape, one.dtype.newbyteorder("=").name, one.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
                run = []
            if k is not None:
                run.append(k)
    if source is None:
        own.close()


class Reader(DataSourceReader):
    """Plans runs of tiles; see the module."""

    COLUMNS = ("channel", "level", "y0", "x0")
    TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}

    def __init__(self, options: dict):
        self.path, self.pushed = options["path"], []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.COLUMNS and type(f) in self.TESTS:
                self.pushed.append((name, type(f).__name__, getattr(f, "value", None)))
            elif not (name in self.COLUMNS and isinstance(f, IsNotNull)):
                yield f

    def _wants(self, **values: int) -> bool:
        tests = {t.__name__: test for t, test in self.TESTS.items()}
        return all(tests[kind](values[name], value) for name, kind, value in self.pushed if name in values)

    def partitions(self) -> list[Tiles]:
        out = []
        for path in files(self.path):
            source, channel = Ranges(path), 0
            for page in directories(source):
                wanted = tuple(s for s in range(page.samples) if self._wants(channel=channel + s))
                for level, own in enumerate(page.levels):
                    if wanted and self._wants(level=level):
                        rows, across = own.grid
                        kept = [r for r in range(rows) if self._wants(y0=r * own.block[0])]
                        per_row = across * own.block[0] * own.block[1] * own.dtype.itemsize
                        step = max(1, PARTITION_BYTES // per_row)
                        # Runs of whole rows of the grid; a row wider than a partition is cut.
                        for k in range(0, len(kept), step):
                            first, last = kept[k] * across, (kept[min(k + step, len(kept)) - 1] + 1) * across
                            wide = max(1, PARTITION_BYTES // (own.block[0] * own.block[1] * own.dtype.itemsize))
                            out += [Tiles(path, own, channel, level, i, min(i + wide, last), wanted) for i in range(first, last, wide)]
                channel += page.samples
            source.close()
        return out or [Tiles(self.path, Page("<"), 0, 0, 0, 0, ())]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        if partition.wanted:
            yield from read_run(partition, lambda y0, x0: self._wants(y0=y0, x0=x0))


# ---------------------------------------------------------------- writing


@dataclass
class Layout:
    """Where every tile of a pyramidal file lies: ``(channels, height, width)`` of one type, and levels that halve, rounded up."""

    channels: int
    height: int
    width: int
    dtype: str
    tile: int
    levels: int
    names: tuple[str, ...] = ()
    pixel_um: float | None = None

    def __post_init__(self):
        if self.tile % 16 or min(self.channels, self.height, self.width, self.tile, self.levels) < 1:
            raise ValueError("sides must be positive, and tiles a multiple of 16")

    def shape(self, level: int) -> tuple[int, int]:
        return -(-self.height // (1 << level)), -(-self.width // (1 << level))

    def grid(self, level: int) -> tuple[int, int]:
        return tuple(-(-n // self.tile) for n in self.shape(level))

    @property
    def tile_bytes(self) -> int:
        return self.tile * self.tile * np.dtype(self.dtype).itemsize

    def place(self, channel: int, level: int, ty: int, tx: int) -> int:
        """Levels lie one after the other, in a level its channels, in a channel its tiles by row."""
        before = sum(np.prod(self.grid(k), dtype=object) for k in range(level)) * self.channels
        rows, across = self.grid(level)
        return 16 + int(before + channel * rows * across + ty * across + tx) * self.tile_bytes

    def directories(self) -> tuple[bytes, bytes]:
        """The header, and all directories with their tables, which follow the last tile."""
        begin = self.place(0, self.levels, 0, 0)
        out = bytearray()
        described = self._description().encode() + b"\0"
        link_at = None
        for c in range(self.channels):
            subs = [self._directory(out, begin, c, k, None, []) for k in range(1, self.levels)]
            at = self._directory(out, begin, c, 0, described if c == 0 else None, subs)
            if link_at is None:
                head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at)
            else:
                out[link_at : link_at + 8] = struct.pack("<Q", at)
            link_at = len(out) - 8
        return head, bytes(out)

    def _description(self) -> str:
        size = f' PhysicalSizeX="{self.pixel_um}" PhysicalSizeY="{self.pixel_um}" PhysicalSizeXUnit="µm" PhysicalSizeYUnit="µm"' if self.pixel_um else ""
        named = [self.names[k] if k < len(self.names) and self.names[k] else f"Channel {k}" for k in range(self.channels)]
        listed = "".join(f'<Channel ID="Channel:0:{k}" Name={quoteattr(n)} SamplesPerPixel="1"/>' for k, n in enumerate(named))
        return f'<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0"><Pixels ID="Pixels:0" DimensionOrder="XYZCT" Type="{self.dtype}" SizeX="{self.width}" SizeY="{self.height}" SizeZ="1" SizeC="{self.channels}" SizeT="1"{size}>{listed}</Pixels></Image></OME>'

    def _directory(self, out: bytearray, begin: int, channel: int, level: int, described: bytes | None, subs: list[int]) -> int:
        """Append one directory and its tables; its place in the file."""
        height, width = self.shape(level)
        rows, across = self.grid(level)
        first = self.place(channel, level, 0, 0)
        places = first + np.arange(rows * across, dtype="<u8") * self.tile_bytes
        kind = np.dtype(self.dtype)
        tags: list[tuple[int, int, bytes]] = [(T.WIDTH, 4, struct.pack("<I", width)), (T.HEIGHT, 4, struct.pack("<I", height)), (T.BITS, 3, struct.pack("<H", kind.itemsize * 8)), (T.COMPRESSION, 3, struct.pack("<H", T.NONE)), (262, 3, struct.pack("<H", 1)), (T.SAMPLES, 3, struct.pack("<H", 1)), (PLANAR, 3, struct.pack("<H", 1))]
        tags += [(T.TILE_WIDTH, 4, struct.pack("<I", self.tile)), (T.TILE_HEIGHT, 4, struct.pack("<I", self.tile)), (T.TILE_AT, 16, places.tobytes()), (T.TILE_SIZE, 16, np.full(len(places), self.tile_bytes, "<u8").tobytes()), (T.SAMPLE_FORMAT, 3, struct.pack("<H", FORMS[kind.kind]))]
        tags += [(254, 4, struct.pack("<I", 1))] if level else []
        tags += [(SUB_IFDS, 18, struct.pack(f"<{len(subs)}Q", *subs))] if subs else []
        tags += [(T.DESCRIPTION, 2, described)] if described else []
        if self.pixel_um:
            per_cm = struct.pack("<II", round(10_000 / self.pixel_um / (1 << level) * 1000), 1000)
            tags += [(282, 5, per_cm), (283, 5, per_cm), (296, 3, struct.pack("<H", 3))]
        sizes, entries = {2: 1, 3: 2, 4: 4, 5: 8, 16: 8, 18: 8}, []
        for tag, type_, body in sorted(tags):
            value = body.ljust(8, b"\0")
            if len(body) > 8:
                value = struct.pack("<Q", begin + len(out))
                out += body + b"\0" * (-len(body) % 8)
            entries.append(struct.pack("<HHQ", tag, type_, len(body) // sizes[type_]) + value)
        at = begin + len(out)
        out += struct.pack("<Q", len(entries)) + b"".join(entries) + b"\0" * 8
        return at

    def fingerprint(self, of: str = "") -> str:
        return hashlib.sha1(json.dumps([vars(self), of], sort_keys=True).encode()).hexdigest()


class Draft:
    """A file under construction and its journal: the fingerprint of what it is made from, and the levels that are whole."""

    def __init__(self, path: str):
        self.path = _local(path)
        self.draft, self.journal = f"{self.path}.draft", f"{self.path}.journal"

    def done(self, fingerprint: str) -> list[int]:
        """The whole levels of a draft of this fingerprint; none if there is no such draft."""
        try:
            with open(self.journal, encoding="utf-8") as f:
                told = json.load(f)
            return told["levels"] if told["fingerprint"] == fingerprint and os.path.exists(self.draft) else []
        except (OSError, ValueError, KeyError):
            return []

    def note(self, fingerprint: str, levels: list[int]) -> None:
        with open(f"{self.journal}.new", "w", encoding="utf-8") as f:
            json.dump({"fingerprint": fingerprint, "levels": sorted(levels)}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.journal}.new", self.journal)

    def begin(self, layout: Layout, fingerprint: str) -> list[int]:
        """Lay out the draft, unless one of the same fingerprint is there; its whole levels."""
        kept = self.done(fingerprint)
        if not kept:
            os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
            head, tail = layout.directories()
            with open(self.draft, "wb") as f:
                f.write(head)
                f.seek(layout.place(0, layout.levels, 0, 0))
                f.write(tail)
            self.note(fingerprint, [])
        return kept

    def finish(self) -> str:
        os.replace(self.draft, self.path)
        os.remove(self.journal)
        return self.path


@dataclass
class Written(WriterCommitMessage):
    tiles: int
    total: int


class Writer(DataSourceArrowWriter):
    """Writes the tiles of one level into a draft; see the module."""

    def __init__(self, options: dict, names: list[str]):
        self.draft, self.level, self.fingerprint = Draft(options["path"]), int(options["level"]), options["fingerprint"]
        self.layout = Layout(**{k: tuple(v) if k == "names" else v for k, v in json.loads(options["layout"]).items()})
        missing = {"channel", "y0", "x0", "h", "w", "px"} - set(names)
        if missing:
            raise ValueError(f"tiles lack {sorted(missing)}")

    def _check(self, c: int, y0: int, x0: int, h: int, w: int, size: int) -> None:
        own, (height, width), item = self.layout, self.layout.shape(self.level), np.dtype(self.layout.dtype).itemsize
        if not (0 <= c < own.channels and 0 <= y0 < height and 0 <= x0 < width and y0 % own.tile == 0 and x0 % own.tile == 0):
            raise ValueError(f"no tile of level {self.level} begins at channel {c}, ({y0}, {x0})")
        if (h, w) != (min(own.tile, height - y0), min(own.tile, width - x0)) or size != h * w * item:
            raise ValueError(f"the tile at ({y0}, {x0}) has {h} x {w} pixels in {size} bytes")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        own, n = self.layout, 0
        out = os.open(self.draft.draft, os.O_WRONLY)
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    self._check(r["channel"], r["y0"], r["x0"], r["h"], r["w"], len(r["px"]))
                    block = np.zeros((own.tile, own.tile), np.dtype(own.dtype).newbyteorder("<"))
                    block[: r["h"], : r["w"]] = np.frombuffer(r["px"], block.dtype).reshape(r["h"], r["w"])
                    os.pwrite(out, block.tobytes(), own.place(r["channel"], self.level, r["y0"] // own.tile, r["x0"] // own.tile))
                    n += 1
            os.fsync(out)
        finally:
            os.close(out)
        return Written(n, n * own.tile_bytes)

    def commit(self, messages: list[Written | None]) -> None:
        n, wanted = sum(m.tiles for m in messages if m), int(np.prod(self.layout.grid(self.level))) * self.layout.channels
        if n != wanted:
            raise ValueError(f"level {self.level} has {wanted} tiles, {n} were written")
        self.draft.note(self.fingerprint, [*self.draft.done(self.fingerprint), self.level])

    def abort(self, messages: list[Written | None]) -> None:
        """The level stays out of the journal and is written anew."""


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)


# ---------------------------------------------------------------- operators on tiles


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of all channels and levels of a file or folder, in their own type."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


def to_pixels(tiles: DataFrame) -> DataFrame:
    """``(path, channel, level, y, x, v)``; whole numbers become long, others double."""
    floats = "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["px"], np.dtype(r["dtype"]).newbyteorder("<"))
                k = np.arange(len(v))
                whole = [None] * len(v) if r["dtype"].startswith(floats) else v.astype(np.int64)
                real = v.astype(float) if r["dtype"].startswith(floats) else [None] * len(v)
                same = lambda x, kind: pa.array([x] * len(v), kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(r["path"], pa.string()), same(r["channel"], pa.int32()), same(r["level"], pa.int32()), pa.array(r["y0"] + k // r["w"]), pa.array(r["x0"] + k % r["w"]), pa.array(whole, pa.int64()), pa.array(real, pa.float64())], names=["path", "channel", "level", "y", "x", "v", "f"])

    return tiles.mapInArrow(run, "path string, channel int, level int, y long, x long, v long, f double")


def read_box(spark: SparkSession, path: str, channel: int, box: tuple[int, int, int, int], level: int = 0) -> DataFrame:
    """``(y, x, v)`` of the box ``(y0, y1, x0, x1)`` of one channel, 0 outside the image; only tiles that meet the box are read."""
    y0, y1, x0, x1 = box
    first = next(iter(files(path)))
    source = Ranges(first)
    pages, at = directories(source), 0
    source.close()
    for page in pages:
        if at <= channel < at + page.samples:
            break
        at += page.samples
    else:
        raise IndexError(f"{first} has {at} channels")
    h, w = page.levels[level].block
    tiles = read_tiles(spark, path).where((F.col("channel") == channel) & (F.col("level") == level) & (F.col("y0") > y0 - h) & (F.col("y0") < y1) & (F.col("x0") > x0 - w) & (F.col("x0") < x1))
    got = to_pixels(tiles).where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).select("y", "x", F.coalesce(F.col("v").cast("double"), "f").alias("v"))
    every = spark.range(y0, y1).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(x0).cast("long"), F.lit(x1 - 1).cast("long"))).alias("x"))
    return every.join(got, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def tiles_of(pixels: DataFrame, layout: Layout) -> DataFrame:
    """Full-size tiles of pixels ``(channel, y, x, v)``; a pixel that is not there is 0, one outside the plane is left out, and a group is one tile."""
    t, (rows, across) = layout.tile, layout.grid(0)
    every = pixels.sparkSession.range(layout.channels * rows * across).selectExpr(f"cast(id div {rows * across} as int) as channel", f"id div {across} % {rows} as ty", f"id % {across} as tx", "cast(null as long) as y", "cast(null as long) as x", "cast(null as double) as v")
    inside = F.col("channel").between(0, layout.channels - 1) & F.col("y").between(0, layout.height - 1) & F.col("x").between(0, layout.width - 1)
    own = pixels.where(inside).selectExpr("cast(channel as int) as channel", f"cast(y div {t} as long) as ty", f"cast(x div {t} as long) as tx", "cast(y as long) as y", "cast(x as long) as x", "cast(v as double) as v")

    def fill(table: pa.Table) -> pa.Table:
        c, ty, tx = (table.column(k)[0].as_py() for k in ("channel", "ty", "tx"))
        block = np.zeros((min(t, layout.height - ty * t), min(t, layout.width - tx * t)), np.dtype(layout.dtype).newbyteorder("<"))
        table = table.drop_null()
        block[table.column("y").to_numpy() - ty * t, table.column("x").to_numpy() - tx * t] = table.column("v").to_numpy()
        return pa.table({"channel": pa.array([c], pa.int32()), "y0": pa.array([ty * t]), "x0": pa.array([tx * t]), "h": pa.array([block.shape[0]], pa.int32()), "w": pa.array([block.shape[1]], pa.int32()), "dtype": [layout.dtype], "px": pa.array([block.tobytes()], pa.binary())})

    return every.unionByName(own).groupBy("channel", "ty", "tx").applyInArrow(fill, "channel int, y0 long, x0 long, h int, w int, dtype string, px binary")


PIECE = "channel int, ty long, tx long, dy int, dx int, h int, w int, px binary"


def _halved(block: np.ndarray) -> np.ndarray:
    """Means of blocks of two by two, of what there is at an odd edge; whole numbers are rounded to the even one."""
    rows, columns = (np.arange(0, n, 2) for n in block.shape)
    total = np.add.reduceat(np.add.reduceat(block.astype(float), rows, 0), columns, 1)
    n = np.outer(*(np.minimum(2, size - at) for size, at in zip(block.shape, (rows, columns))))
    mean = total / n
    return (np.rint(mean) if block.dtype.kind in "ui" else mean).astype(block.dtype)


def _pieces(tile: int, dtype: str, halve: bool):
    """What each tile gives to the tiles of the file that is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                block, y0, x0 = np.frombuffer(r["px"], np.dtype(r["dtype"]).newbyteorder("<")).reshape(r["h"], r["w"]), r["y0"], r["x0"]
                if halve:
                    block, y0, x0 = _halved(block), y0 // 2, x0 // 2
                block = block.astype(np.dtype(dtype).newbyteorder("<"))
                for ty in range(y0 // tile, (y0 + block.shape[0] - 1) // tile + 1):
                    for tx in range(x0 // tile, (x0 + block.shape[1] - 1) // tile + 1):
                        a, b = max(ty * tile, y0), max(tx * tile, x0)
                        own = block[a - y0 : (ty + 1) * tile - y0, b - x0 : (tx + 1) * tile - x0]
                        rows.append({"channel": r["channel"], "ty": ty, "tx": tx, "dy": a - ty * tile, "dx": b - tx * tile, "h": own.shape[0], "w": own.shape[1], "px": own.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("channel", pa.int32()), ("ty", pa.int64()), ("tx", pa.int64()), *((k, pa.int32()) for k in ("dy", "dx", "h", "w")), ("px", pa.binary())]))

    return run


def _joined(tile: int, shape: tuple[int, int], dtype: str):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        c, ty, tx = (rows[0][k] for k in ("channel", "ty", "tx"))
        block = np.zeros((min(tile, shape[0] - ty * tile), min(tile, shape[1] - tx * tile)), np.dtype(dtype).newbyteorder("<"))
        for r in rows:
            block[r["dy"] : r["dy"] + r["h"], r["dx"] : r["dx"] + r["w"]] = np.frombuffer(r["px"], block.dtype).reshape(r["h"], r["w"])
        return pa.table({"channel": pa.array([c], pa.int32()), "y0": pa.array([ty * tile]), "x0": pa.array([tx * tile]), "h": pa.array([block.shape[0]], pa.int32()), "w": pa.array([block.shape[1]], pa.int32()), "px": pa.array([block.tobytes()], pa.binary())})

    return run


def retiled(tiles: DataFrame, layout: Layout, level: int, halve: bool) -> DataFrame:
    """Tiles of a level of ``layout`` from tiles of any size, or from those of the level before; pieces are shuffled, a group is one tile."""
    pieces = tiles.select("channel", "y0", "x0", "h", "w", "dtype", "px").mapInArrow(_pieces(layout.tile, layout.dtype, halve), PIECE)
    return pieces.groupBy("channel", "ty", "tx").applyInArrow(_joined(layout.tile, layout.shape(level), layout.dtype), "channel int, y0 long, x0 long, h int, w int, px binary")


def write_pyramid(tiles: DataFrame, path: str, layout: Layout, of: str = "") -> list[int]:
    """Write tiles ``(channel, y0, x0, h, w, dtype, px)`` of full size and all smaller levels as one BigTIFF; the levels written now.

    A draft that was left by a run of the same fingerprint (the layout and ``of``,
    which should name the input) is taken up after its last whole level; any other
    is begun anew.  Each level is made from the one before it in the draft.
    """
    spark, draft, fingerprint = tiles.sparkSession, Draft(path), layout.fingerprint(of)
    register(spark)
    whole, built = draft.begin(layout, fingerprint), []
    for level in range(layout.levels):
        if level in whole and not built:
            continue
        if level:
            tiles = spark.read.format(FORMAT).load(f"{draft.draft}").where(F.col("level") == level - 1)
        options = {"level": level, "fingerprint": fingerprint, "layout": json.dumps(vars(layout))}
        retiled(tiles, layout, level, level > 0).write.format(FORMAT).mode("append").options(**options).save(draft.path)
        built.append(level)
    draft.finish()
    return built


def to_pyramid(spark: SparkSession, source: str, path: str, tile: int = 512, least: int = 128) -> list[int]:
    """A flat file of one type as a pyramidal one, its levels halving while both sides are above ``least``; the levels written now."""
    own = Ranges(source)
    pages = directories(own)
    names, shapes = channel_names(own, pages), {(p.shape, p.dtype.newbyteorder("=").name) for p in pages}
    size = own.file.size()
    own.close()
    if len(shapes) != 1:
        raise ValueError(f"{source}: pages differ in shape or type")
    (((height, width), dtype),) = shapes
    levels = 1
    while min(-(-height // (1 << levels - 1)), -(-width // (1 << levels - 1))) > least:
        levels += 1
    layout = Layout(len(names), height, width, dtype, tile, levels, tuple(names))
    flat = read_tiles(spark, source).where("level = 0")
    return write_pyramid(flat, path, layout, json.dumps([source, size, os.stat(_local(source)).st_mtime_ns if "://" not in source or source.startswith("file:") else 0]))
