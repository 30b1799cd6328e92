"""Vectorised text kernels shared by the corpus operators.

All of them work on the UTF-8 bytes of a block of whole texts at once: one byte
array, one array of text offsets.  Words are found by a 256-entry table of
delimiter bytes, hashed by a polynomial over random 64-bit byte values, and
combined into hashes of consecutive words.  A block holds ``BLOCK_BYTES`` or one
longer text, so a worker's memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporaries take about 60 times as much.
BLOCK_BYTES = 1 << 19

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=U64) | U64(1)
_P = U64(0x9E3779B97F4A7C15 | 1)
_PINV = U64(pow(int(_P), -1, 1 << 64))
#: Odd multipliers of the words of an n-gram.
_MULT = _RNG.integers(0, 1 << 64, 64, dtype=U64) | U64(1)

#: Delimiter bytes of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Delimiter bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text).
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the usual block size only."""
    if n > 2 * BLOCK_BYTES or len(_POWERS.get("p", ())) < n:
        size = n if n > 2 * BLOCK_BYTES else 2 * BLOCK_BYTES
        with np.errstate(over="ignore"):
            p, q = np.full(size, _P), np.full(size, _PINV)
            p[0] = q[0] = 1
            p, q = np.cumprod(p, dtype=U64), np.cumprod(q, dtype=U64)
        if n > 2 * BLOCK_BYTES:
            return p, q
        _POWERS["p"], _POWERS["q"] = p, q
    return _POWERS["p"][:n], _POWERS["q"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts in them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of runs of whole texts of at most ``limit`` bytes, or one longer text."""
    limit = limit or BLOCK_BYTES
    raw, at = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(raw: np.ndarray, at: np.ndarray, delimiters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, in order; no word runs from one text into the next."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~delimiters[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    begins = edge[:-1] & word
    ends = edge[1:] & word
    cut = np.unique(at[1:-1])
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut] |= word[cut]
    ends[cut - 1] |= word[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(starts):
        return np.zeros(0, U64)
    p, q = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * p[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * q[starts]
        return mix(h + (ends - starts).astype(U64) * _P)


def owners(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text and the n + 1 offsets of its words."""
    first = np.searchsorted(starts, at)
    return np.diff(first), first


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, the index of their first word, and the n + 1 offsets by text."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1] * _MULT[0]
        for j in range(1, n):
            out += h[j : len(h) - n + 1 + j] * _MULT[j]
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    begin = np.repeat(first[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    return mix(out[begin]), begin, offsets


def sequence_hash(h: np.ndarray) -> int:
    """The hash of one whole sequence of fewer words than an n-gram has."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(h * _MULT[: len(h)], dtype=U64) + U64(len(h))], U64))[0])


def trim() -> None:
    """Give memory that is free but held back to the system: idle workers count against their executor."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
