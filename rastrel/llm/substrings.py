"""Suffix-array deduplication of substrings of ``length`` bytes.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else
too.  The suffixes that matter are found first:

* Every window of ``length`` bytes has an anchor: its leftmost ``K`` bytes of least
  hash.  Equal windows have equal anchors at equal offsets, so the windows of one
  anchor, a segment, need comparing only with segments of equal anchor bytes.
* Segments whose anchor bytes stand nowhere else are done; segments that stand
  whole in two places are repeated; what is left are the borders of repeats.

Their suffixes from the anchor on, and their prefixes before it read backwards,
are sorted by mergesort.  Two of them are compared by binary search for the
longest common extension over prefix polynomial hashes.  The order and all common
extensions of neighbours are then verified on the bytes; a collision sorts again
with other hashes.  Neighbours' extensions give the classes of equal contexts on
either side, and windows of one class on both sides are equal.

An anchor with more than ``most`` different segments (a passage of a third of all
documents has as many borders) is not sorted in one task: its windows are halved
by offset, and a half is keyed by the bytes that its windows share, until few
segments share a key or one window is left, for which the key itself decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .bitmaps import BITMAP_LOG, mark
from .scratch import Scratch

#: Bytes of an anchor, bytes of segments sorted at once, and segments of one key sorted at once.
K, BUCKET_BYTES, MOST = 32, 4 << 20, 4096
#: Texts whose segments a task remembers having handed on.
SEEN = 50_000
U64 = np.uint64
CAND = "key binary, kmer long, s1 long, s2 long, back int, windows int, places array<int>"
SEGMENT = ["kmer", "s1", "s2"]
PIECE = "kmer long, s1 long, s2 long, back int, windows int, bytes binary"
PART = "g1 long, g2 long, x int, y int, " + PIECE


class Prefixes:
    """Prefix polynomial hashes of a byte array; any of its substrings is hashed in constant time."""

    def __init__(self, raw: np.ndarray, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        letters = rng.integers(0, 1 << 64, 256, dtype=U64) | U64(1)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        with np.errstate(over="ignore"):
            power, self.inverse = np.full(len(raw) + 1, U64(base)), np.full(len(raw) + 1, U64(pow(base, -1, 1 << 64)))
            power[0] = self.inverse[0] = 1
            power, self.inverse = np.cumprod(power, dtype=U64), np.cumprod(self.inverse, dtype=U64)
            self.sums = np.zeros(len(raw) + 1, U64)
            np.cumsum(letters[raw] * power[:-1], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[last] - self.sums[first]) * self.inverse[first]


# ---------------------------------------------------------------- segments


def segments(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each segment the text, first byte, anchor, number of windows, and hashes of the anchor's bytes and of all bytes (two)."""
    sizes = np.diff(at)
    count = np.maximum(sizes - length + 1, 0)
    if not count.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, U64) for _ in range(3))
    one, two = Prefixes(raw, 1), Prefixes(raw, 2)
    place = np.arange(len(raw) - K + 1)
    h = T.mix(one.of(place, place + K))
    least = (h >> U64(34) << U64(34)) | place.astype(U64)  # of equal hashes the leftmost
    span, width = 1, length - K + 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    window = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    anchor = (least[window] & U64((1 << 34) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), count)
    opens = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    n = np.diff(np.append(opens, len(window)))
    first, anchor = window[opens], anchor[opens]
    last = first + n - 1 + length
    return text[opens], first, anchor, n, h[anchor], T.mix(one.of(first, last) + n.astype(U64)), T.mix(two.of(first, last) + n.astype(U64))


def in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & U64(len(bits) * 8 - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _bitmap(df: DataFrame, hashed: str, log_bits: int):
    """A bitmap of the hashes, of ``2 ** log_bits`` bits (15 or more), broadcast."""
    at = F.col(hashed).bitwiseAND(F.lit((1 << log_bits) - 1))
    rows = df.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros((max(1, 1 << log_bits - 15), 4096), np.uint8)
    for r in rows.collect():  # at most 2 ** (log_bits - 15) rows of 4 KB
        bits[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(bits.ravel())


def _kmers(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in T.blocks(batch.column(1)):
                kmers, n = np.unique(segments(raw, at, length)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kmers.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["kmer", "n"])
        T.trim()

    return run


def _candidates(length: int, bits):
    """One row for each different segment of a text whose anchor's bytes may stand elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, raw, at in T.blocks(batch.column(1)):
                text, first, anchor, n, kmer, s1, s2 = segments(raw, at, length)
                keep = np.flatnonzero(in_bits(bits.value, kmer))
                order = keep[np.lexsort((first[keep], s2[keep], s1[keep], kmer[keep], text[keep]))]
                text, first, anchor, n, kmer, s1, s2 = (x[order] for x in (text, first, anchor, n, kmer, s1, s2))
                new = np.ones(len(order), bool)
                new[1:] = (text[1:] != text[:-1]) | (kmer[1:] != kmer[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
                row = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(row, len(order)), pa.int32()), pa.array(first - at[text], pa.int32()))
                whole = [x.view(np.int64)[row] for x in (kmer, s1, s2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(begin + text[row])), *(pa.array(x, pa.int64()) for x in whole), pa.array((anchor - first)[row], pa.int32()), pa.array(n[row], pa.int32()), places],
                    names=["key", "kmer", "s1", "s2", "back", "windows", "places"],
                )
        T.trim()

    return run


def _bytes(length: int, bits):
    """The bytes of segments that may be asked for; copies of a text within a task hand them on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, hint = batch.column(0).to_pylist(), batch.column(2).to_numpy().view(U64)
            for begin, end, raw, at in T.blocks(batch.column(1)):
                text, first, anchor, n, kmer, s1, s2 = segments(raw, at, length)
                fresh = np.zeros(end - begin, bool)
                for i, k in enumerate(keys[begin:end]):
                    if k not in seen:
                        fresh[i] = True
                        if len(seen) < SEEN:
                            seen.add(k)
                row = np.flatnonzero(fresh[text] & in_bits(bits.value, s1 ^ hint[begin + text]))
                size = n[row] - 1 + length
                where = np.repeat(first[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(raw[where].tobytes())])
                whole = [x.view(np.int64)[row] for x in (kmer, s1, s2)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in whole), pa.array((anchor - first)[row], pa.int32()), pa.array(n[row], pa.int32()), data], names=["kmer", "s1", "s2", "back", "windows", "bytes"])
        T.trim()

    return run


# ---------------------------------------------------------------- suffix sort


class Collision(Exception):
    """Hashes were equal, the bytes were not."""


class Suffixes:
    """Strings that run from ``begin`` on for ``size`` bytes, or backwards from before it, sorted within their groups."""

    def __init__(self, raw: np.ndarray, prefixes: Prefixes, begin: np.ndarray, size: np.ndarray, group: np.ndarray, backwards: bool):
        self.raw, self.prefixes, self.begin, self.size, self.backwards = raw, prefixes, begin, size, backwards
        self.order = np.argsort(group, kind="stable")
        self.group = group[self.order]
        opens = np.flatnonzero(np.diff(self.group, prepend=self.group[:1] - 1) != 0)
        n = np.diff(np.append(opens, len(group)))
        self.first, self.last = np.repeat(opens, n), np.repeat(opens + n, n)
        self._mergesort(int(n.max(initial=0)))
        self.common = self._neighbours()

    def _hash(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.prefixes.of(self.begin[i] - n, self.begin[i]) if self.backwards else self.prefixes.of(self.begin[i], self.begin[i] + n)

    def _letter(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The byte there, plus one; 0 behind the end."""
        there = at < self.size[i]
        where = self.begin[i] - 1 - at if self.backwards else self.begin[i] + at
        return np.where(there, self.raw[np.where(there, where, 0)].astype(np.int64) + 1, 0)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the strings share from their start, by binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self._hash(i[open_], middle) == self._hash(j[open_], middle)
            low[open_], high[open_] = np.where(same, middle, low[open_]), np.where(same, high[open_], middle - 1)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = self.extension(i, j)
        return self._letter(i, at) - self._letter(j, at)

    def _mergesort(self, largest: int) -> None:
        """Runs of a group are merged two by two: a string's place is its own in its run and its rank in the other."""
        width = 1
        while width < largest:
            place = np.arange(len(self.order))
            local = place - self.first
            run = local // width
            low = self.first + (run ^ 1) * width
            rows = np.flatnonzero(low < self.last)
            low, begin = low[rows], low[rows]
            high = np.minimum(low + width, self.last[rows])
            right = run[rows] & 1 > 0
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                sign = self.compare(self.order[middle], self.order[rows[open_]])
                before = (sign < 0) | ((sign == 0) & right[open_])
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
            place[rows] = (self.first + run // 2 * 2 * width + local % width)[rows] + low - begin
            merged = np.empty_like(self.order)
            merged[place] = self.order
            self.order, width = merged, width * 2

    def _neighbours(self) -> np.ndarray:
        """What each string shares with the one before it in its group (-1: none is), verified on the bytes."""
        common = np.full(len(self.order), -1, np.int64)
        later = np.flatnonzero(np.arange(len(self.order)) > self.first)
        i, j = self.order[later - 1], self.order[later]
        n = self.extension(i, j)
        common[later] = n
        step = np.repeat(np.cumsum(n) - n, n)
        step = np.arange(len(step)) - step
        sign = -1 if self.backwards else 1
        x, y = (np.repeat(self.begin[k] - self.backwards, n) + sign * step for k in (i, j))
        if (self.raw[x] != self.raw[y]).any():
            raise Collision
        before, after = self._letter(i, n), self._letter(j, n)
        if ((before > after) | ((before == after) & (before > 0))).any():
            raise Collision
        return common

    def classes(self, least: np.ndarray) -> np.ndarray:
        """For each of ``least`` a class number of each string: equal where the first ``least`` bytes are."""
        out = np.empty((len(least), len(self.order)), np.int32)
        out[:, self.order] = np.cumsum(self.common[None, :] < least[:, None], axis=1)
        return out


def repeated_windows(data: list[bytes], group: np.ndarray, back: np.ndarray, windows: np.ndarray, x: np.ndarray, y: np.ndarray, length: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The first and last window of each segment that another segment of its group has at the same offset; -1 if none has.

    Offsets of the anchor in a window count from ``x`` to ``y`` only.
    """
    raw = np.frombuffer(b"".join(data), np.uint8)
    size = np.array([len(d) for d in data])
    anchor = np.cumsum(size) - size + back
    try:
        prefixes = Prefixes(raw, seed)
        after = Suffixes(raw, prefixes, anchor, size - back, group, False)
        before = Suffixes(raw, prefixes, anchor, back.astype(np.int64), group, True)
    except Collision:
        return repeated_windows(data, group, back, windows, x, y, length, seed + 1)
    first, last = np.full(len(data), -1, np.int64), np.full(len(data), -1, np.int64)
    low, high = np.maximum(back - windows + 1, x), np.minimum(back, y)
    for begin in range(0, length - K + 1, 16):
        offset = np.arange(begin, min(begin + 16, length - K + 1))
        code = after.classes(length - offset).astype(np.int64) * (len(data) + 1) + before.classes(offset)
        inside = (low[None, :] <= offset[:, None]) & (offset[:, None] <= high[None, :])
        code = np.where(inside, code, -1 - np.arange(len(data))[None, :])
        order = np.argsort(code, axis=1)
        code = np.take_along_axis(code, order, 1)
        same = code[:, 1:] == code[:, :-1]
        hit = np.zeros(code.shape, bool)
        hit[:, 1:] |= same
        hit[:, :-1] |= same
        row, at = np.nonzero(hit)
        who = order[row, at]
        window = back[who] - offset[row]
        np.maximum.at(last, who, window)
        lowest = np.where(first < 0, 1 << 40, first)
        np.minimum.at(lowest, who, window)
        first = np.where(lowest == 1 << 40, -1, lowest)
    return first, last


def _sorted_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g1").to_numpy() ^ T.mix(table.column("g2").to_numpy().view(U64)).view(np.int64)
        back, windows, x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("back", "windows", "x", "y"))
        first, last = repeated_windows(table.column("bytes").to_pylist(), g, back, windows, x, y, length)
        found = pa.array(first >= 0)
        out = pa.table([*(table.column(c) for c in SEGMENT), pa.array(first, pa.int32()), pa.array(last + length, pa.int32())], names=[*SEGMENT, "first", "last"])
        return out.filter(found)

    return run


def _halves(length: int):
    """Each part twice, with half of its offsets, keyed by the bytes that all windows of the half share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                middle = (r["x"] + r["y"]) // 2
                for x, y in ((r["x"], middle), (middle + 1, r["y"])):
                    if x <= y and x <= r["back"] and y >= r["back"] - r["windows"] + 1:
                        core = r["bytes"][r["back"] - x : r["back"] - y + length]
                        digest = xxhash.xxh3_128_digest(core, seed=x * 1024 + y)
                        rows.append(r | {"x": x, "y": y, "g1": int.from_bytes(digest[:8], "little", signed=True), "g2": int.from_bytes(digest[8:], "little", signed=True)})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


# ---------------------------------------------------------------- operator


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        spans, kept = [], []
        for text, codes in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            code = np.unique(np.fromiter((c for own in codes or () for c in own), np.int64))
            first, last = code >> 32, np.maximum.accumulate(code & 0xFFFFFFFF)
            new = np.ones(len(first), bool)
            new[1:] = first[1:] > last[:-1]
            at = np.flatnonzero(new)
            own = list(zip(first[at].tolist(), last[np.append(at[1:], len(first)) - 1].tolist())) if len(at) else []
            spans.append([{"first": a, "last": b} for a, b in own])
            kept.append(b"".join([text[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(text)])]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])


def dedup_substrings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, bucket_bytes: int = BUCKET_BYTES, bitmap_log: int = BITMAP_LOG) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for each row of ``docs``.

    ``spans`` are the maximal runs ``(first, last)`` of bytes, ``last`` excluded,
    that lie in strings of ``length`` bytes which start anywhere else too, in the
    same text or another; ``kept`` is the rest, which may no longer be whole
    characters.  Strings are judged on the input, so the first copy goes as well.

    Null and empty texts have no bytes; texts shorter than ``length`` keep all;
    equal rows are each other's copies, whatever their ids, and a null id is an id
    like any other; an empty table gives an empty table; other columns are not
    read.  Texts may have any length below 2^31 bytes: a task holds one whole, and
    a run of one letter is one segment with many places.  Texts and segments that
    stand whole in several places are known by 128 bits of hash; what the suffix
    sort finds is verified on the bytes.  The bitmaps have a fixed size and only
    save work: the joins after them are exact.
    """
    if not 2 * K <= length <= 1024:
        raise ValueError(f"length must lie in {2 * K}..1024")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    keyed = rows.where(F.octet_length("text") >= length).select(key.alias("key"), "text", F.xxhash64(key).alias("hint"))

    kmers = keyed.mapInArrow(_kmers(length), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n")).where("n > 1").select("kmer")
    kmers = scratch.save(kmers, "kmers")
    cand = keyed.mapInArrow(_candidates(length, _bitmap(kmers, "kmer", bitmap_log)), CAND).join(kmers, "kmer")
    cand = cand.groupBy("key", *SEGMENT, "back", "windows", "places").agg(F.count("*").alias("copies"))
    cand = scratch.save(cand, "candidates")
    segs = cand.groupBy(*SEGMENT).agg(F.sum(F.col("copies") * F.size("places")).alias("n"), F.min(F.xxhash64("key")).alias("hint"), F.max("windows").alias("windows"))
    segs = scratch.save(segs, "segments")
    kinds = segs.groupBy("kmer").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("kmer", "kinds")
    asked = scratch.save(segs.join(kinds, "kmer").select(*SEGMENT, "n", "hint", "kinds"), "asked")

    wanted = asked.select(F.col("s1").bitwiseXOR(F.col("hint")).alias("h"))  # of one text each
    pieces = keyed.mapInArrow(_bytes(length, _bitmap(wanted, "h", bitmap_log)), PIECE).join(asked.select(*SEGMENT, "n", "kinds"), SEGMENT).dropDuplicates(SEGMENT)
    pieces = scratch.save(pieces, "pieces")

    part = lambda df: df.select(F.col("kmer").alias("g1"), F.lit(0).cast("long").alias("g2"), F.lit(0).alias("x"), F.lit(length - K).alias("y"), *SEGMENT, "back", "windows", "bytes")
    sortable, hot = part(pieces.where(F.col("kinds") <= most)), part(pieces.where(F.col("kinds") > most))
    settled = segs.where("n > 1").select(*SEGMENT, F.lit(0).alias("first"), (F.col("windows") - 1 + length).cast("int").alias("last"))
    level = 0
    while not hot.isEmpty():  # at most log2(length) rounds
        level += 1
        halves = scratch.save(hot.mapInArrow(_halves(length), PART), f"halves-{level}")
        counted = halves.groupBy("g1", "g2").agg(F.count("*").alias("kinds")).where("kinds > 1")
        counted = scratch.save(halves.join(counted, ["g1", "g2"]), f"counted-{level}")
        one = (F.col("kinds") > most) & (F.col("x") == F.col("y"))  # a single window: the key is the whole of it
        at = F.col("back") - F.col("x")
        settled = settled.unionByName(counted.where(one).select(*SEGMENT, at.cast("int").alias("first"), (at + length).cast("int").alias("last")))
        sortable = sortable.unionByName(counted.where(F.col("kinds") <= most).drop("kinds"))
        hot = counted.where((F.col("kinds") > most) & ~one).drop("kinds")
    held = sortable.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("g1", "g2"), F.lit(max(1, held // bucket_bytes)))
    found = sortable.groupBy(bucket.alias("bucket")).applyInArrow(_sorted_bucket(length), "kmer long, s1 long, s2 long, first int, last int")
    found = settled.unionByName(found).groupBy(*SEGMENT).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = scratch.save(found, "found")

    code = F.transform("places", lambda p: F.shiftleft((p + F.col("first")).cast("long"), 32) + p + F.col("last"))
    ranges = cand.join(found, SEGMENT).select("key", code.alias("codes")).groupBy("key").agg(F.collect_list("codes").alias("codes"))
    ranges = scratch.save(ranges, "ranges")
    scratch.drop("kmers", "candidates", "segments", "asked", "pieces", "found", *(f"{x}-{k}" for k in range(1, level + 1) for x in ("halves", "counted")))
    return _cut(rows, key, ranges, length, bitmap_log)


def _cut(rows: DataFrame, key, ranges: DataFrame, length: int, bitmap_log: int) -> DataFrame:
    """Texts that surely keep all stay where they are; the others meet their ranges."""
    marked = mark(rows.withColumn("key", key), F.col("key"), ranges.select("key"), "maybe", bitmap_log)
    maybe = F.col("maybe") & (F.octet_length("text") >= length)
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    whole = marked.where(~maybe).select("doc_id", none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    met = marked.where(maybe).select("doc_id", "text", "key").join(ranges, "key", "left").select("doc_id", "text", "codes")
    cut = met.mapInArrow(_removed, "doc_id long, spans array<struct<first:bigint,last:bigint>>, kept binary")
    size = F.octet_length("kept").cast("long") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return whole.unionByName(cut).select("doc_id", size.alias("n_bytes"), "spans", "kept")
