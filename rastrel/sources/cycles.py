"""Imaging cycles of one slide as one pyramidal file: registered one by one, each committed to a manifest, taken up again where a run was left.

A cycle is one transaction.  Its registered tiles are written to a folder of its
own, which a rerun overwrites; then the manifest that calls it complete replaces
the one before by renaming.  So a run that dies leaves whole cycles, and of the
one at work nothing that counts.  The file is made once all are there; then the
folders go and the manifest stays, as the record of what the file was made from.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elastic as E
from ..operators import merging as M
from ..scratch import Steps
from . import bigtiff as B
from .levels import _path, is_done


class Cancelled(RuntimeError):
    """The caller asked to stop; what is complete stays."""


@dataclass
class Cycle:
    """Tiles ``(channel, y0, x0, h, w, dtype, px)`` of full size, and what the manifest knows them by: ``version`` has to change with the pixels."""

    number: int
    tiles: DataFrame
    names: tuple[str, ...]
    height: int
    width: int
    dtype: str
    version: str
    marker: str = "DAPI"

    def marker_channel(self) -> int:
        """The channel that is registered: the one of the marker's name in either case, else the first that has it inside."""
        low, want = [n.lower() for n in self.names], self.marker.lower()
        found = [c for c, n in enumerate(low) if n == want] or [c for c, n in enumerate(low) if want in n]
        if not found:
            raise ValueError(f"cycle {self.number} has no channel {self.marker!r}: {', '.join(self.names)}")
        return found[0]


@dataclass(frozen=True)
class Settings:
    """How cycles are registered and written; all of it is part of the fingerprint."""

    reference: int | None = None
    size: int = 512
    coarse: int = 8
    steps: int = 10
    tile: int = 512
    levels: int = 1
    touch_up: bool = False
    rigid_bound: int = 16
    bound: float = 12.0
    kernel: str = "bspline"


@dataclass
class Plan:
    """The canvas, the channels and the order of a merge."""

    cycles: dict[int, Cycle]
    order: list[int]
    offsets: dict[int, int]
    names: list[str]
    height: int
    width: int
    dtype: str
    fingerprint: str = field(default="")


def cycle_of_file(spark: SparkSession, path: str, number: int, marker: str = "DAPI") -> Cycle:
    """A cycle of a TIFF file, known by its path, size and time of change."""
    source = B.Ranges(path)
    pages = B.directories(source)
    names = B.channel_names(source, pages)
    source.close()
    fs, p = _path(spark, path)
    status = fs.getFileStatus(p)
    tiles = B.read_tiles(spark, path).where("level = 0")
    return Cycle(number, tiles, tuple(names), *pages[0].shape, pages[0].dtype.newbyteorder("=").name, f"{path} {status.getLen()} {status.getModificationTime()}", marker)


def plan(cycles: list[Cycle], how: Settings) -> Plan:
    """Channels by cycle number, named ``<name>_cy<number>`` (``_2`` for a second one); the reference is written first.  Raises on no cycles, numbers that repeat or are negative, and types that differ."""
    numbers = [c.number for c in cycles]
    if not cycles or min(numbers) < 0 or len(set(numbers)) != len(numbers):
        raise ValueError(f"cycles need numbers of their own from 0 on: {numbers}")
    if len({c.dtype for c in cycles}) > 1:
        raise ValueError("cycles differ in type: " + ", ".join(f"{c.number} {c.dtype}" for c in cycles))
    by = {c.number: c for c in sorted(cycles, key=lambda c: c.number)}
    reference = min(by) if how.reference is None else how.reference
    if reference not in by:
        raise ValueError(f"no cycle {reference} to register to")
    offsets, names, seen = {}, [], {}
    for c in by.values():
        offsets[c.number] = len(names)
        for name in c.names:
            stem = f"{name.strip() or 'Channel'}_cy{c.number}"
            seen[stem] = seen.get(stem, 0) + 1
            names.append(stem if seen[stem] == 1 else f"{stem}_{seen[stem]}")
        c.marker_channel()
    out = Plan(by, [reference, *(n for n in by if n != reference)], offsets, names, max(c.height for c in cycles), max(c.width for c in cycles), cycles[0].dtype)
    told = [vars(how), out.order, names, out.height, out.width, [[c.number, c.names, c.height, c.width, c.dtype, c.version, c.marker] for c in by.values()]]
    out.fingerprint = hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
    return out


# ---------------------------------------------------------------- manifest


def load_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest; none if it is missing, not JSON, or not what its checksum says. Any other failure to read it is raised."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
        return told if isinstance(told, dict) else None
    except ValueError:
        return None
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getName().endswith(".ChecksumException"):
            raise
        return None
    finally:
        stream.close()


def save_manifest(spark: SparkSession, path: str, told: dict) -> None:
    """Written beside the old manifest, which it then replaces in one rename: a reader sees either, never a part."""
    jvm, (fs, p) = spark.sparkContext._jvm, _path(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(told, sort_keys=True, indent=1).encode()))
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(kind, 1)
    overwrite[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(p), overwrite)


def complete_cycles(spark: SparkSession, told: dict | None, wanted: Plan, stage: str) -> list[int]:
    """Cycles at the head of the order that need not be written: the manifest is of this fingerprint, calls them complete, and their folder has its mark."""
    if not told or told.get("fingerprint") != wanted.fingerprint:
        return []
    out = []
    for n in wanted.order:
        if told.get("cycles", {}).get(str(n), {}).get("status") != "complete" or not is_done(spark, f"{stage}/cycle={n}"):
            break
        out.append(n)
    return out


# ---------------------------------------------------------------- merge


def _typed(tiles: DataFrame, dtype: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                px = M.as_type(np.frombuffer(r["px"], "<f4").reshape(r["h"], r["w"]), dtype)
                rows.append(r | {"dtype": dtype, "px": px.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, E._schema(M.MOVED))

    return tiles.mapInArrow(run, M.MOVED)


def _registered(cycle: Cycle, wanted: Plan, how: Settings, steps: Steps) -> tuple[DataFrame, tuple[float, float]]:
    """The cycle's tiles on the canvas, and the shift of the whole of it; the reference is not moved."""
    to_canvas = lambda dy, dx, of=cycle.tiles: M.moved(of, dy, dx, wanted.height, wanted.width, how.tile, wanted.dtype)
    ahead = wanted.cycles[wanted.order[0]]
    if cycle is ahead:
        return to_canvas(0.0, 0.0), (0.0, 0.0)
    marker = lambda c: c.tiles.where(F.col("channel") == c.marker_channel())
    dy, dx = M.slide_shift(marker(ahead), marker(cycle), wanted.height, wanted.width, how.size, how.coarse, 1 if how.touch_up else how.steps)
    if not how.touch_up:
        return to_canvas(dy, dx), (dy, dx)
    # A whole shift moves origins only, so pixels are interpolated once, by the field.
    near = cycle.tiles.withColumn("y0", F.col("y0") + int(dy)).withColumn("x0", F.col("x0") + int(dx))
    own = near.where(F.col("channel") == cycle.marker_channel())
    fields = steps.save(E.blended(E.elastic_fields(marker(ahead), own, marker(ahead), wanted.height, wanted.width, how.size, how.rigid_bound, how.bound, how.kernel), wanted.height, wanted.width, how.size))
    out = None
    for c in range(len(cycle.names)):
        one = E.apply_field(near.where(F.col("channel") == c), fields, wanted.height, wanted.width, how.size // 2, int(how.rigid_bound + how.bound) + 1)
        one = one.select(F.lit(c).alias("channel"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return _typed(out, wanted.dtype), (dy, dx)


def merge(spark: SparkSession, cycles: list[Cycle], path: str, how: Settings | None = None, mode: str = "resume", cancel: Callable[[], bool] = lambda: False) -> list[dict]:
    """Merge cycles into ``path``; rows ``(cycle, action, dy, dx)``, the file as cycle null.

    ``mode``: ``resume`` keeps what a run of the same fingerprint completed (all of
    it, once the file is there) and begins anew after any other; ``force`` begins
    anew; ``dry`` says what ``resume`` would do and writes nothing.  ``cancel`` is
    asked before each cycle and before the file is made.
    """
    if mode not in ("resume", "force", "dry"):
        raise ValueError(f"no mode {mode!r}")
    how = how or Settings()
    wanted, stage, record = plan(cycles, how), f"{path}.cycles", f"{path}.manifest.json"
    told = None if mode == "force" else load_manifest(spark, record)
    same = bool(told) and told.get("fingerprint") == wanted.fingerprint
    fs, out = _path(spark, path)
    if same and told.get("status") == "complete" and fs.exists(out):
        return [{"cycle": n, "action": "kept", **_shift(told, n)} for n in wanted.order] + [{"cycle": None, "action": "kept", "dy": None, "dx": None}]
    kept = complete_cycles(spark, told, wanted, stage)
    if mode == "dry":
        return [{"cycle": n, "action": "kept" if n in kept else "to build", **(_shift(told, n) if n in kept else {"dy": None, "dx": None})} for n in wanted.order] + [{"cycle": None, "action": "to build", "dy": None, "dx": None}]
    if not kept:
        fs.delete(_path(spark, stage)[1], True)
        told = {"fingerprint": wanted.fingerprint, "status": "pending", "order": wanted.order, "cycles": {str(n): {"status": "pending", "channel": wanted.offsets[n], "channels": len(wanted.cycles[n].names)} for n in wanted.order}}
        save_manifest(spark, record, told)
    rows, steps = [], Steps(spark, "merge")
    for n in wanted.order:
        if n not in kept:
            if cancel():
                raise Cancelled(f"before cycle {n}")
            tiles, (dy, dx) = _registered(wanted.cycles[n], wanted, how, steps)
            tiles.withColumn("channel", F.col("channel") + wanted.offsets[n]).write.mode("overwrite").parquet(f"{stage}/cycle={n}")
            told["cycles"][str(n)] |= {"status": "complete", "dy": dy, "dx": dx}
            save_manifest(spark, record, told)
        rows.append({"cycle": n, "action": "kept" if n in kept else "built", **_shift(told, n)})
    if cancel():
        raise Cancelled("before the file is made")
    layout = B.Layout(len(wanted.names), wanted.height, wanted.width, wanted.dtype, how.tile, how.levels, tuple(wanted.names))
    B.write_pyramid(spark.read.parquet(*[f"{stage}/cycle={n}" for n in wanted.order]), path, layout, wanted.fingerprint)
    save_manifest(spark, record, told | {"status": "complete"})
    fs.delete(_path(spark, stage)[1], True)
    return [*rows, {"cycle": None, "action": "built", "dy": None, "dx": None}]


def _shift(told: dict, n: int) -> dict:
    return {k: told["cycles"][str(n)].get(k) for k in ("dy", "dx")}
