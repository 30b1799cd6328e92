"""Token-ID output: one wavelet matrix file for each shard.

A file holds, each in separately compressed blocks, the ids in use, the documents
and their lengths, and the bit-planes of a wavelet matrix with a directory of
ranks.  Tokens can be read, counted and found without decoding the rest: a query
opens the blocks that its positions fall in and no others.

Layout: ``MAGIC``, the length of the header (8 bytes, little-endian), the header
(JSON), the blocks.  The header lists for every section the kind of its values,
their number and the offsets of its blocks after the header.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import BLOCK_BYTES, trim

MAGIC = b"RSTLWM01"
#: Bits of a plane's block, and of a step of the rank directory.
BLOCK_BITS, STEP_BITS = 1 << 19, 1 << 12
#: Tokens after which a shard is closed, at the end of a document.
SHARD_TOKENS = 1 << 21
#: Tokens of one step of a pass over a shard: temporaries take about 20 times as many bytes.
PASS_TOKENS = 1 << 18
SUFFIX = "wvm"


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard: ``ids`` of all its documents in order, ``lengths`` by document."""
    n = len(ids)
    alphabet, codes = _dense(ids)
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
    codes = codes.astype(np.uint16 if levels <= 16 else np.uint32, copy=False)
    pack = zstandard.ZstdCompressor(level=1)
    blocks: list[bytes] = []
    at = 0

    def section(kind: str, raw: bytes, count: int, step: int) -> dict:
        nonlocal at
        offsets = [at]
        for i in range(0, max(len(raw), 1), step):
            blocks.append(pack.compress(raw[i : i + step]))
            at += len(blocks[-1])
            offsets.append(at)
        return {"kind": kind, "count": count, "step": step, "offsets": offsets}

    nulls = sum(d is None for d in doc_ids)
    head = {
        "tokens": n, "levels": levels, "null_ids": nulls, "zeros": [],
        "alphabet": section("<u4", alphabet.astype("<u4").tobytes(), len(alphabet), 1 << 20),
        "doc_ids": section("<i8", np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), len(doc_ids), 1 << 20),
        "lengths": section("<i8", np.asarray(lengths, "<i8").tobytes(), len(lengths), 1 << 20),
        "planes": [], "ranks": [],
    }
    for level in range(levels):
        bit = (codes & codes.dtype.type(1 << (levels - 1 - level))) != 0
        plane = np.packbits(bit, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), STEP_BITS // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(ones)])
        head["planes"].append(section("bits", plane.tobytes(), n, BLOCK_BITS // 8))
        head["ranks"].append(section("<u4", before.astype("<u4").tobytes(), len(before), 1 << 20))
        head["zeros"].append(int(n - before[-1]))
        codes = _parted(codes, bit, head["zeros"][-1])
    header = json.dumps(head).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *blocks])


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in use, ascending, and the place of each token's id among them."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (most := int(ids.max())) < 1 << 24:
        used = np.zeros(most + 1, bool)
        steps = range(0, len(ids), PASS_TOKENS)
        for i in steps:
            used[ids[i : i + PASS_TOKENS]] = True
        place = np.cumsum(used, dtype=np.int32) - 1
        codes = np.empty(len(ids), np.uint16 if place[-1] < 1 << 16 else np.int32)
        for i in steps:
            codes[i : i + PASS_TOKENS] = place[ids[i : i + PASS_TOKENS]]
        return np.flatnonzero(used), codes
    return np.unique(ids, return_inverse=True)


def _parted(codes: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """The codes whose bit is 0, ``zeros`` in number, then the others, each in their order."""
    out, at, ones = np.empty_like(codes), 0, zeros
    for i in range(0, len(codes), PASS_TOKENS):
        step, b = codes[i : i + PASS_TOKENS], bit[i : i + PASS_TOKENS]
        low, high = step.take(np.flatnonzero(~b)), step.take(np.flatnonzero(b))  # faster than masks
        out[at : at + len(low)], out[ones : ones + len(high)] = low, high
        at, ones = at + len(low), ones + len(high)
    return out


class WaveletFile:
    """Reads one shard's bytes; only the blocks that a call needs are decompressed."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(raw[8:16], "little")
        self.head = json.loads(raw[16 : 16 + size])
        self.body = memoryview(raw)[16 + size :]
        self.tokens, self.levels, self.zeros = self.head["tokens"], self.head["levels"], self.head["zeros"]
        self._open: dict[int, bytes] = {}
        self.alphabet = self._all(self.head["alphabet"])

    def _block(self, section: dict, k: int) -> bytes:
        at, end = section["offsets"][k : k + 2]
        if at not in self._open:
            if len(self._open) > 256:
                self._open.clear()
            self._open[at] = zstandard.ZstdDecompressor().decompress(self.body[at:end])
        return self._open[at]

    def _all(self, section: dict) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor()
        raw = b"".join(unpack.decompress(self.body[a:b]) for a, b in zip(section["offsets"], section["offsets"][1:]))
        return np.frombuffer(raw, np.uint8 if section["kind"] == "bits" else section["kind"])

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids = self._all(self.head["doc_ids"]).tolist()
        nulls = self.head["null_ids"]
        return [None] * nulls + ids[nulls:], self._all(self.head["lengths"])

    def decode(self) -> np.ndarray:
        """All tokens, from the last plane back to the first."""
        codes = np.zeros(self.tokens, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self._all(self.head["planes"][level]), count=self.tokens, bitorder="little").view(bool)
            place, zeros = np.empty_like(codes), self.zeros[level]
            place[np.flatnonzero(~bit)] = codes[:zeros]
            place[np.flatnonzero(bit)] = codes[zeros:] | codes.dtype.type(1 << (self.levels - 1 - level))
            codes = place
        return self.alphabet[codes] if len(self.alphabet) else codes.astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        step = i // STEP_BITS
        ranks = self.head["ranks"][level]
        per = ranks["step"] // 4
        before = int(np.frombuffer(self._block(ranks, step // per), "<u4")[step % per])
        if i == step * STEP_BITS:
            return before
        block = self._block(self.head["planes"][level], step * STEP_BITS // BLOCK_BITS)
        first = step * STEP_BITS % BLOCK_BITS // 8
        bits = np.unpackbits(np.frombuffer(block, np.uint8)[first : first + STEP_BITS // 8], bitorder="little")
        return before + int(bits[: i - step * STEP_BITS].sum())

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) 1 or 0 of a plane."""
        low, high = 0, self.tokens
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        """Token ``i``."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            i = self.zeros[level] + ones if bit else i - ones
            code = code * 2 + bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of ``token`` in ``[first, last)``."""
        code, last = self._code(token), self.tokens if last is None else last
        if code is None:
            return 0
        for level in range(self.levels):
            a, b = self._ones(level, first), self._ones(level, last)
            first, last = (self.zeros[level] + a, self.zeros[level] + b) if code >> (self.levels - 1 - level) & 1 else (first - a, last - b)
        return last - first

    def locate(self, token: int, k: int) -> int | None:
        """The place of occurrence ``k`` (from 0) of ``token``; None if there are fewer."""
        code = self._code(token)
        if code is None or k < 0 or k >= self.count(token):
            return None
        first = 0
        for level in range(self.levels):
            ones = self._ones(level, first)
            first = self.zeros[level] + ones if code >> (self.levels - 1 - level) & 1 else first - ones
        i = first + k
        for level in reversed(range(self.levels)):
            bit = code >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i


# ---------------------------------------------------------------- tokens

#: Words above which a worker forgets those used least, and words of one call to the tokenizer.
CACHED_WORDS, CALL_WORDS = 200_000, 500
_ALNUM, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_PUNCT[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True  # all of ASCII but the apostrophe


#: Stands for the end of a text; no UTF-8 text holds this byte.
_END = b"\xff"


def _words(texts: list[bytes]) -> list[bytes]:
    """The words of all texts, ``_END`` after each, cut further where any word tokenizer that lower-cases would cut.

    A block that may name a special token is cut at white space alone.  A letter
    before a character outside ASCII stays as it is, since the tokenizer composes
    the two before it lower-cases them.
    """
    text = b" \xff ".join([*texts, b""])
    if b"<|" in text:
        return text.split()
    given, text = np.frombuffer(text, np.uint8), text.lower()
    raw = np.frombuffer(text, np.uint8)
    alnum, punct = _ALNUM[raw], _PUNCT[raw]
    edge = (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])
    cut = np.flatnonzero(edge) + 1
    before = np.flatnonzero(given[1:] >= 0x80)
    before = before[given[before] != raw[before]]
    if len(before):
        raw = raw.copy()
        raw[before] = given[before]
        text = raw.tobytes()
    if len(cut):
        old = np.ones(len(raw) + len(cut), bool)
        old[cut + np.arange(len(cut))] = False
        out = np.full(len(old), 0x20, np.uint8)
        out[old] = raw
        text = out.tobytes()
    return text.split()


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library.

    ``by_words`` is for tokenizers that lower-case, drop white space and mark the
    end of a word: then words are encoded once and looked up after that.
    """

    def __init__(self, model: str, end_id: int | None, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.by_words = Tokenizer.from_str(model), end_id, by_words
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.number: dict[bytes, int] = {_END: 0}  # word 0 is the end of a text
        self.flat = np.array([] if self.end is None else [self.end], np.int32)
        self.sizes = np.array([len(self.flat)], np.int32)
        self.uses = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the words that were used most, half as many as fit, and none that was used once."""
        keep = np.flatnonzero(self.uses > 1)
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: CACHED_WORDS // 2]])
        keep = np.concatenate([[0], keep[keep > 0]])
        chosen = np.zeros(len(self.sizes), bool)
        chosen[keep] = True
        self.number = {w: i for i, w in enumerate(compress(self.number, chosen))}  # numbers are in the order of insertion
        self.flat = self.flat[np.repeat(chosen, self.sizes)]
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] // 2

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters go to the tokenizer side by side: each ends with its first closing token."""
        plain = [w for w in words if w.isalpha()]  # of ASCII letters
        other = []
        for w in words:
            if not w.isalpha():
                (plain if (s := w.decode()).isalpha() and s.lower().isalpha() else other).append(w)
        order, flats, sizes = [], [], []
        for i in range(0, len(plain), CALL_WORDS):
            group = plain[i : i + CALL_WORDS]
            ids = np.array(self._raw([b" ".join(group).decode()])[0], np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                order += group
                flats.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                other += group
        got = self._raw([w.decode() for w in other])
        flats.append(np.fromiter((i for ids in got for i in ids), np.int32))
        sizes.append(np.array([len(ids) for ids in got], np.int64))
        first = len(self.sizes)
        self.number.update(zip(order + other, range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, *flats])
        self.sizes = np.concatenate([self.sizes, *sizes]).astype(np.int32)
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by the end id, and their numbers by text."""
        if not self.by_words:
            tail = [] if self.end is None else [self.end]
            got = [ids + tail for ids in self._raw([t.decode() for t in texts])]
            return np.array([i for g in got for i in g], np.int32), np.array([len(g) for g in got], np.int64)
        if len(self.number) > CACHED_WORDS:
            self._forget()
        words = _words(texts)
        code = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            lost = [words[i] for i in missing]
            self._learn(list(dict.fromkeys(lost)))
            code[missing] = [self.number[w] for w in lost]
        self.uses += np.bincount(code, minlength=len(self.uses))
        size = self.sizes[code]
        last = np.cumsum(size, dtype=np.int32 if len(code) < 1 << 24 else np.int64)
        ids = self.flat[np.repeat((np.cumsum(self.sizes, dtype=last.dtype) - self.sizes)[code] - (last - size), size) + np.arange(last[-1] if len(last) else 0, dtype=last.dtype)]
        return ids, np.diff(last[np.flatnonzero(code == 0)].astype(np.int64), prepend=0)


#: Seconds after its last task in which a worker keeps its words.
IDLE_SECONDS = 5.0
_ENCODERS: dict[tuple, Encoder] = {}
_TIMERS: list[threading.Timer] = []


def encoder(model: str, end_id: int | None, by_words: bool) -> Encoder:
    """One encoder for each worker process; its words serve the next task too, if that follows at once."""
    while _TIMERS:
        _TIMERS.pop().cancel()
    key = (xxhash.xxh3_128_digest(model), end_id, by_words)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        trim()  # what earlier stages left
        _ENCODERS[key] = Encoder(model, end_id, by_words)
    return _ENCODERS[key]


def _leave_soon() -> None:
    """Drop the words once the worker has been idle for a while, so that other stages have the memory."""

    def drop() -> None:
        _ENCODERS.clear()
        trim()

    _TIMERS.append(threading.Timer(IDLE_SECONDS, drop))
    _TIMERS[-1].daemon = True
    _TIMERS[-1].start()


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer of this name lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _write(root: str, name: str, raw: bytes) -> str:
    """Write under a name of this attempt, then move: a repeated task leaves the same file."""
    from pyarrow import fs

    where = root.replace("s3a://", "s3://") if "://" in root else root.removeprefix("file:")
    store, base = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
    store.create_dir(base, recursive=True)
    draft = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(raw)
    store.move(draft, f"{base}/{name}")
    return f"{root}/{name}"


def _shards(model, end_id: int | None, by_words: bool, root: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, seq, coder = task.partitionId() if task else 0, 0, encoder(model.value, end_id, by_words)
        ids, docs, lengths, held = [], [], [], 0

        def close():
            name = f"part-{part:06d}-{seq:06d}.{SUFFIX}"
            _write(root, name, build(np.concatenate(ids), docs, np.concatenate(lengths)))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64())], names=["shard", "part", "seq", "n_docs", "n_tokens"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in texts), np.int64, len(texts))
            names = batch.column(0).to_pylist()
            first = 0
            while first < len(texts):  # a block of texts at a time
                last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), BLOCK_BYTES, "right")))
                got, length = coder.encode(texts.slice(first, last - first).to_pylist())
                cut, begin = np.concatenate([[0], np.cumsum(length)]), 0
                while begin < len(length):
                    end = begin + max(1, int(np.searchsorted(cut[begin + 1 :] - cut[begin], most - held, "right")))
                    ids.append(got[cut[begin] : cut[end]]), lengths.append(length[begin:end])
                    docs += names[first + begin : first + end]
                    held += int(cut[end] - cut[begin])
                    begin = end
                    if held >= most or begin < len(length):
                        yield close()
                        ids, docs, lengths, held, seq = [], [], [], 0, seq + 1
                first = last
        if docs:
            yield close()
        del coder
        _leave_soon()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = WaveletFile(raw.as_buffer().to_pybytes())
            ids, (docs, lengths) = shard.decode().astype("<u4"), shard.documents()
            cut = np.concatenate([[0], np.cumsum(lengths)])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(docs)), pa.array(docs, pa.int64()), pa.array(cut[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", by_words: bool = True, shard_tokens: int = SHARD_TOKENS, scratch: Scratch | None = None) -> tuple[str, DataFrame]:
    """Write ``docs`` in ascending id order; the folder of the files and a table of them.

    Null ids come first; rows that repeat an id stand side by side, those of one
    text together, and may fall to several tasks, as may equal rows; a null text
    is empty and gives the end id alone; a text of any length is encoded whole
    and stands in one file; an empty table writes no file.  Files land in the
    shared folder under their final names only when whole.  Other columns are
    not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    root = f"{scratch.path}/files"
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Ranges end between ids, between texts of one id, and between equal rows, whose order does not matter.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("turn", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "turn"]
    ordered = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = scratch.save(ordered.mapInArrow(_shards(model, end_id, by_words, root, shard_tokens), "shard string, part long, seq long, n_docs long, n_tokens long"), "shards")
    return root, made


def read_tokens(root: str, shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, shard)`` of each document, from the files."""
    spark = shards.sparkSession
    empty = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"
    if shards.isEmpty():
        return spark.createDataFrame([], empty)
    # Prefix sums in two steps: within the shards of a task, and over tasks.
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(across), F.lit(0)))
    offsets = shards.join(parts, "part").select("shard", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("offset"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{SUFFIX}").load(root).select("path", "content")
    found = files.mapInArrow(_read, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
