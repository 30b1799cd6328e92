"""Exact n-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct word n-grams, as 64-bit hashes.  The
join runs in four steps, none of which sees all pairs of a group:

1. *Shared tokens.*  A pair that links has at least 3/4 of either set in common,
   so a document links with others only if 3/4 of its tokens occur in another
   set.  Token counts are gathered by token range: each chunk of documents sends
   one entry for each token it holds, packed in sorted blocks, and gets back the
   entries that other chunks hold too, with their document frequency.  Equal
   sets are then one class with one representative, and the step is repeated on
   the representatives, so that frequencies count different sets.
2. *Signatures.*  Tokens are ordered by frequency.  Rare tokens are indexed one by
   one; frequent ones in combinations of k tokens of one hash group, k growing
   with frequency; the borders are quantiles of the frequencies of all prefixes.  A group of a k-token class covers its tokens in the prefix
   less k - 1; the prefix is extended until |x| - o + 1 tokens are covered, o
   being the least overlap of a link.  Any pair that links then shares a
   signature: fewer than that many of the prefix that ends first can miss the
   other set, hence some group has k tokens in both.
3. *Stars.*  Each signature's documents are compared with its smallest document;
   links give components.
4. *The rest.*  Signatures whose documents still lie in different components are
   compared exactly, in blocks: parity bitmaps bound the overlap from above, the
   pairs of different components that pass are counted on the token sets, and
   only links that join two components come out.

Tokens keep 48 bits from step 1 on.  A pair that one token more or less would
turn into a link, or no link, is decided on the words of both texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import connected_components
from .bitmaps import mark
from .scratch import Scratch, fresh

U64 = np.uint64
#: Fewest tokens and most documents of one chunk; a document's number in its chunk has 16 bits.
CHUNK_TOKENS, CHUNK_DOCS = 1 << 19, 1 << 15
#: Tokens of one range, and most ranges; bytes of text for a token; bytes of text for each task that counts.
RANGE_TOKENS, MOST_RANGES, TOKEN_BYTES, TASK_BYTES = 1 << 21, 1 << 18, 6, 128 << 20
#: Share of all prefixes' tokens that lies above each class border, and the highest borders.
CLASS_SHARES, CLASS_MOST = (0.03, 0.008), (4096, 65536)
MANY = 0xFFFF
#: Documents of one block when the rest is compared.
BLOCK_DOCS = 1024

ENTRIES = "g long, chunk long, body binary"
RETURNS = "chunk long, body binary"
SETS = "doc_id long, n_shingles long, fp binary, toks binary, dfs binary"
SIGS = "sig long, doc_id long, n_shingles long, k long"


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes; planes that are zero throughout cost nothing."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        planes = np.ascontiguousarray(a, U64).view(np.uint8).reshape(-1, 8)
        width = 8
        while width and not planes[:, width - 1].any():
            width -= 1
        parts += [np.array([len(a), width], np.int64).tobytes(), np.ascontiguousarray(planes[:, :width].T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(body: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    at, out = 8, []
    for _ in range(int(raw[:8].view(np.int64)[0])):
        n, width = (int(x) for x in raw[at : at + 16].view(np.int64))
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = raw[at + 16 : at + 16 + n * width].reshape(width, n).T
        out.append(planes.reshape(-1).view(U64))
        at += 16 + n * width
        if at % 8:  # views need aligned bytes
            raw, at = raw[at:].copy(), 0
    return out


def _deltas(sorted_values: np.ndarray, base: int = 0) -> np.ndarray:
    return np.diff(sorted_values, prepend=U64(base))


def shingle_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Document ids and their sorted distinct token hashes, block by block, of ``(doc_id, text)`` batches."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, raw, at in T.blocks(batch.column(1)):
            raw = T.LOWER[raw]
            starts, ends = T.spans(raw, at, T.SPACES)
            h = T.hashes(raw, starts, ends)
            words, word_at = T.owners(starts, at)
            g, _, g_at = T.grams(h, word_at, n)
            sets = []
            for i in range(last - first):
                if words[i] >= n:
                    sets.append(np.unique(g[g_at[i] : g_at[i + 1]]))
                elif words[i]:
                    sets.append(np.array([T.sequence_hash(h[word_at[i] : word_at[i + 1]])], U64))
                else:
                    sets.append(np.zeros(0, U64))
            yield ids[first:last], sets


def _chunk_rows(number: int, ids: list, sizes: list, prints: list[bytes], sets: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """A chunk's entries by token range, and one row of what stays with the chunk."""
    docs = np.repeat(np.arange(len(sets), dtype=U64), [len(s) for s in sets])
    keys = np.concatenate([*sets, np.zeros(0, U64)])
    keys = np.sort((keys & ~U64(MANY)) | docs)
    toks = keys >> U64(16)
    begins = np.flatnonzero(np.diff(toks, prepend=~U64(0)))
    counts = np.diff(begins, append=len(toks))
    one = counts == 1
    uniq, doc = toks[begins], np.where(one, keys[begins] & U64(MANY), U64(MANY))
    local = np.repeat(~one, counts)
    yield buckets + number, number, _pack(np.array(ids, np.int64).view(U64), np.array(sizes, U64), np.frombuffer(b"".join(prints), U64), keys[local] & U64(MANY), _deltas(toks[local]))
    edges = (np.arange(buckets + 1, dtype=object) << 48) // buckets
    edges = np.array([int(x) + bool((int(k) << 48) % buckets) for k, x in enumerate(edges)], U64)
    cut = np.searchsorted(uniq, edges)
    for b in np.flatnonzero(np.diff(cut)):
        part = slice(cut[b], cut[b + 1])
        many = counts[part][~one[part]]
        yield int(b), number, _pack(_deltas(uniq[part], int(edges[b])), doc[part], many)


def _emit(buckets: int, docs: Iterator[tuple[int, int, bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Entries of ``(id, set size, fingerprint, tokens)``, chunk by chunk."""
    from pyspark import TaskContext

    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24

    def flush():
        rows = list(_chunk_rows(number, ids, sizes, prints, sets, buckets))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["g", "chunk", "body"])

    ids, sizes, prints, sets, held = [], [], [], [], 0
    for i, n, fp, s in docs:
        ids.append(i), sizes.append(n), prints.append(fp), sets.append(s)
        held += len(s)
        if held >= max(CHUNK_TOKENS, 16 * buckets) or len(ids) >= CHUNK_DOCS:
            yield flush()
            ids, sizes, prints, sets, held = [], [], [], [], 0
            number += 1
    if ids:
        yield flush()
    del ids, sizes, prints, sets
    T.trim()


def _from_texts(n: int, buckets: int):
    def run(batches):
        def docs():
            for ids, sets in shingle_sets(batches, n):
                for i, s in zip(ids.tolist(), sets):
                    yield i, len(s), xxhash.xxh3_128_digest(s.tobytes()), s

        yield from _emit(buckets, docs())

    return run


def _from_sets(buckets: int):
    def run(batches):
        def docs():
            for b in batches:
                for i, n, fp, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    yield i, n, fp, np.frombuffer(toks, U64) << U64(16)

        yield from _emit(buckets, docs())

    return run


def _count_range(buckets: int):
    """For one token range, or one chunk's own row: what each chunk gets back."""

    def run(key, table):
        g, chunks, bodies = key[0].as_py(), table.column("chunk").to_pylist(), table.column("body").to_pylist()
        if g >= buckets:
            return pa.table({"chunk": pa.array(chunks, pa.int64()), "body": pa.array(bodies, pa.binary())})
        base = U64(-(-(g << 48) // buckets))
        parts = [_unpack(b) for b in bodies]
        toks = [np.cumsum(p[0], dtype=U64) + base for p in parts]
        counts = []
        for p in parts:
            c = np.ones(len(p[0]), U64)
            c[p[1] == MANY] = p[2]
            counts.append(c)
        values, inverse = np.unique(np.concatenate(toks), return_inverse=True)
        df = np.bincount(inverse, weights=np.concatenate(counts).astype(float)).astype(U64)[inverse]
        out, at = [], 0
        for t, p in zip(toks, parts):
            d = df[at : at + len(t)]
            at += len(t)
            keep = d >= 2
            out.append(_pack(_deltas(t[keep]), p[1][keep], d[keep]))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "body": pa.array(out, pa.binary())})

    return run


def _assemble(num: int, den: int):
    """One chunk's documents with their shared tokens, where enough of them are shared."""

    def run(table):
        toks, docs, dfs = [], [], []
        for body in table.column("body").to_pylist():
            arrays = _unpack(body)
            if len(arrays) == 5:
                ids, sizes, prints, local_doc, local = arrays[0].view(np.int64), arrays[1].astype(np.int64), arrays[2].tobytes(), arrays[3], np.cumsum(arrays[4], dtype=U64)
            else:
                toks.append(np.cumsum(arrays[0], dtype=U64)), docs.append(arrays[1]), dfs.append(arrays[2])
        toks, docs, dfs = (np.concatenate([*x, np.zeros(0, U64)]) for x in (toks, docs, dfs))
        many = docs == MANY
        order = np.argsort(toks[many])
        seen, seen_df = toks[many][order], dfs[many][order]
        local_df = seen_df[np.searchsorted(seen, local)] if len(local) else np.zeros(0, U64)
        toks, docs, dfs = np.concatenate([toks[~many], local]), np.concatenate([docs[~many], local_doc]), np.concatenate([dfs[~many], local_df])
        order = np.lexsort((toks, docs))
        toks, dfs = toks[order], np.minimum(dfs[order], 0xFFFFFFFF).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(np.bincount(docs.astype(np.int64), minlength=len(ids)))])
        kept = ((np.diff(at) + 1) * den >= sizes * num) & (sizes > 0)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()),
            "fp": pa.array([prints[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()),
            "toks": pa.array([toks[at[i] : at[i + 1]].tobytes() if kept[i] else None for i in range(len(ids))], pa.binary()),
            "dfs": pa.array([dfs[at[i] : at[i + 1]].tobytes() if kept[i] else None for i in range(len(ids))], pa.binary()),
        })

    return run


def _shared_tokens(entries: DataFrame, buckets: int, tasks: int, num: int, den: int) -> DataFrame:
    counted = entries.repartition(tasks, "g").groupBy("g").applyInArrow(_count_range(buckets), RETURNS)
    return counted.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(_assemble(num, den), SETS)


# ---------------------------------------------------------------- signatures


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def _level(n: int, num: int, den: int) -> int:
    """Sizes of a linking pair differ by at most one level."""
    return int(math.log(n) / math.log(den / num * 1.005))


def _prefix(toks: np.ndarray, dfs: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and frequencies, rarest first, and how many of them the prefix has to cover (one more, since two tokens may share 48 bits)."""
    order = np.lexsort((toks, dfs))
    return toks[order], dfs[order], len(toks) - least_overlap(n, num, den) + 2


def _frequencies(num: int, den: int):
    """Counts of prefix tokens by eighths of the binary logarithm of their document frequency."""

    def run(batches):
        counts = np.zeros(512, np.int64)
        for b in batches:
            for n, toks, dfs in zip(*(b.column(k).to_pylist() for k in range(3))):
                _, d, need = _prefix(np.frombuffer(toks, U64), np.frombuffer(dfs, np.uint32), n, num, den)
                counts += np.bincount((8 * np.log2(d[:need])).astype(np.int64), minlength=512)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(512)), pa.array(counts)], names=["step", "n"])

    return run


def class_borders(counts: np.ndarray, shares: tuple[float, ...] = CLASS_SHARES, most: tuple[int, ...] = CLASS_MOST) -> list[int]:
    """Document frequencies above which tokens are in class 2, 3, ...: at most a share of all prefix tokens, and all above the highest border."""
    above = np.cumsum(counts[::-1])[::-1]  # tokens at a step or beyond it
    out: list[int] = []
    for share, cap in zip(shares, most):
        step = int(np.argmax(above <= share * max(above[0], 1)))
        border = min(max(math.ceil(2 ** (step / 8)) - 1, 2), cap)
        out.append(min(max(border, out[-1] + 1), cap) if out else border)
    return out


def signatures(toks: np.ndarray, dfs: np.ndarray, n: int, num: int, den: int, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signature hashes of one document, and how many tokens each combines.

    ``classes``: ascending document frequencies; a token above k of them is in
    class k + 1 and is indexed in combinations of k + 1.  A document belongs to
    its size level and the next, and the number of hash groups of a class follows
    the level, so linking documents group alike on a common level.
    """
    # Tokens that no other set has come first in the order; the prefix has them all.
    toks, dfs, need = _prefix(toks, dfs, n, num, den)
    k_of = np.searchsorted(np.array(classes), dfs, "left") + 1
    ones, singles = int(np.searchsorted(k_of, 1, "right")), 0
    combined: dict[int, list[tuple[int, ...]]] = {}
    own = _level(n, num, den)
    for level in (own, own + 1):
        groups = int((den / num * 1.005) ** (level - 1)) // 8  # at most an 8th of the smallest size on this level
        if not groups or ones >= need:
            singles = need
            continue
        singles, covered = max(singles, ones), ones
        held: dict[tuple[int, int], list[int]] = {}
        where = (T.mix(toks[ones:] + U64(level)) % U64(groups)).tolist()
        for t, k, w in zip(toks[ones:].tolist(), k_of[ones:].tolist(), where):
            if covered >= need:
                break
            group = held.setdefault((k, w), [])
            if len(group) >= k - 1:
                covered += 1
                combined.setdefault(k, []).extend((level * 8 + k, *sorted((*rest, t))) for rest in combinations(group, k - 1))
            group.append(t)
    out, ks = [T.mix(toks[:singles])], [np.ones(min(singles, len(toks)), np.int64)]
    for k, rows in combined.items():
        parts = np.array(rows, U64)
        with np.errstate(over="ignore"):
            out.append(T.mix(np.sum(T.mix(parts[:, 1:]) * T._MULT[:k], axis=1, dtype=U64) + parts[:, 0]))
        ks.append(np.full(len(rows), k))
    sigs, first = np.unique(np.concatenate(out), return_index=True)
    return sigs, np.concatenate(ks)[first]


def parity_bits(toks: np.ndarray) -> np.ndarray:
    """A bitmap in which each token flips one bit; 4 to 8 bits for each token."""
    m = 1 << max(9, int(4 * max(len(toks), 1) - 1).bit_length())
    hit = np.bincount((T.mix(toks) & U64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(hit.astype(np.uint8), bitorder="little").view(U64)


def _sign(num: int, den: int, classes: list[int]):
    def run(batches):
        for b in batches:
            sigs, ids, sizes, ks = [], [], [], []
            for i, n, toks, dfs in zip(*(b.column(k).to_pylist() for k in range(4))):
                s, k = signatures(np.frombuffer(toks, U64), np.frombuffer(dfs, np.uint32), n, num, den, classes)
                sigs.append(s), ks.append(k)
                ids.append(np.full(len(s), i)), sizes.append(np.full(len(s), n))
            if ids:
                columns = [np.concatenate(sigs).view(np.int64), *(np.concatenate(x) for x in (ids, sizes, ks))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sig", "doc_id", "n_shingles", "k"])

    return run


def _verdict(both, total, num: int, den: int):
    """Whether sets of ``total`` tokens together link, and whether one common token more or less would not change that."""
    links = lambda x: den * x >= num * (total - x)
    return links(both), links(both - 1) == links(both + 1)


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            keep, sure = [], []
            for n, m, x, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))):
                both = len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True))
                link, clear = _verdict(both, n + m, num, den)
                keep.append(link or not clear), sure.append(clear)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), pa.array(sure, pa.bool_()).filter(mask)], names=["a", "b", "sure"])

    return run


def _named(n: int):
    """``(class, text)`` of the texts that have the fingerprint asked for."""

    def run(batches):
        for b in batches:
            whole = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["class", "text"])
            at, wanted = 0, b.column(2).to_pylist()
            for _, sets in shingle_sets([whole], n):
                keep = [xxhash.xxh3_128_digest(s.tobytes()) == w for s, w in zip(sets, wanted[at : at + len(sets)])]
                yield whole.slice(at, len(sets)).filter(pa.array(keep, pa.bool_()))
                at += len(sets)

    return run


def _words(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    words = text.lower().split()  # of bytes: A-Z alone are lowered, and 0x09-0x0D and 0x20 separate
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))}


def _decide(n: int, num: int, den: int):
    """The pairs whose texts link, by their words."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).cast(pa.binary()).to_pylist()):
                x, y = _words(x, n), _words(y, n)
                keep.append(den * len(x & y) >= num * len(x | y))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return run


def _settled(pairs: DataFrame, rows: DataFrame, rep: DataFrame, n: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """``(a, b)``: the sure links, and of the others those that the texts of both classes confirm."""
    open_ = pairs.where("not sure").select("a", "b").distinct()
    asked = open_.select(F.col("a").alias("class")).union(open_.select("b")).distinct().join(rep, "class").select("class", "rep", "fp")
    asked = scratch.save(asked, f"{name}-asked")  # a file whose size is known: a small one is broadcast, and the texts stay where they are
    texts = rows.join(asked, F.col("doc_id") == F.col("rep")).select("class", "text", "fp").mapInArrow(_named(n), "class long, text string").dropDuplicates(["class"])
    side = lambda x: texts.select(F.col("class").alias(x), F.col("text").alias(f"text_{x}"))
    told = open_.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_decide(n, num, den), "a long, b long")
    return pairs.where("sure").select("a", "b").union(told)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _screen(num: int, den: int):
    """The documents of a block that may link with one of another component."""

    def run(key, table):
        table = table.sort_by("n_shingles")
        ids, n, comp = (table.column(c).to_numpy() for c in ("doc_id", "n_shingles", "comp"))
        side = table.column("side").to_numpy()
        shared = table.column("n_toks").to_numpy()
        bits = [np.frombuffer(x, U64) for x in table.column("bits").to_pylist()]
        width = np.array([len(x) for x in bits])
        stacks = {w: np.stack([bits[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width)}
        row = np.zeros(len(ids), np.int64)
        for w in stacks:
            row[width == w] = np.arange(len(stacks[w]))
        hit = np.zeros(len(ids), bool)
        for i in range(len(ids)):
            last = np.searchsorted(n, n[i] * den // num, "right")
            near = np.arange(i + 1, last)
            near = near[(comp[near] != comp[i]) & ((side[near] != side[i]) | (side[i] == 2))]
            for w in np.unique(width[near]):
                j = near[width[near] == w]
                small = min(w, width[i])
                apart = np.bitwise_count(_fold(stacks[w][row[j]], small) ^ _fold(bits[i][None, :], small)).sum(1, dtype=np.int64)
                most = (shared[i] + shared[j] - apart) // 2 + 2  # two tokens of a set may share 48 bits
                ok = den * most >= num * (n[i] + n[j] - most)
                hit[j[ok]] = True
                hit[i] |= ok.any()
        return pa.table({"sig": pa.array([key[0].as_py()] * int(hit.sum()), pa.int64()), "part": pa.array([key[1].as_py()] * int(hit.sum()), pa.int64()), "doc_id": pa.array(ids[hit], pa.int64()), "comp": pa.array(comp[hit], pa.int64())})

    return run


def _exact(num: int, den: int):
    """Links of a block that join two components."""

    def run(table):
        ids, n, comp = (table.column(c).to_numpy() for c in ("doc_id", "n_shingles", "comp"))
        sets = [np.frombuffer(x, U64) for x in table.column("toks").to_pylist()]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        by = np.argsort(token, kind="stable")
        posts, post_at = owner[by], np.concatenate([[0], np.cumsum(np.bincount(token))])
        token_at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b, sure, unsure = [], [], [], []
        for i in range(len(ids)):
            t = token[token_at[i] : token_at[i + 1]]
            both = np.bincount(np.concatenate([posts[post_at[x] : post_at[x + 1]] for x in t]), minlength=len(ids))
            link, clear = _verdict(both, n[i] + n, num, den)
            apart = comp != comp[i]
            for j in np.flatnonzero(link & clear & apart).tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(ids[i]), b.append(ids[j]), sure.append(True)
            unsure += [(i, j) for j in np.flatnonzero(~clear & apart).tolist() if i < j]
        for i, j in unsure:
            if find(int(comp[i])) != find(int(comp[j])):
                a.append(ids[i]), b.append(ids[j]), sure.append(False)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return run


def _bits(batches):
    for b in batches:
        sets = [np.frombuffer(x, U64) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_bits(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n_shingles", "n_toks", "bits"])


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: tuple[int, int] = (3, 4), classes: tuple[int, ...] | None = None, report: dict | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of lower-cased
    (A-Z) word n-grams is at least ``similarity``; a component is what links
    reach, named by its smallest id.  A text of fewer than ``n`` words is one
    token; a null, empty or blank text has none and links with nothing.  Rows
    that repeat an id give a row each, and link what the texts of the id link; a
    null id links nothing and has no component.  Tokens of equal frequency are
    ordered by their hash.  An empty table gives an empty table.  Texts may have
    any length: a task holds one document's tokens, or those of one range.  Other
    columns are not read.

    ``classes`` are the document frequencies above which tokens are indexed in
    pairs, triples and so on; None takes them from the frequencies of all
    prefixes (``CLASS_SHARES``).  They change the work, never the result.
    ``report`` is given the borders and the number of signatures by their size.
    The number of token ranges follows the bytes of text, so a range has about
    ``RANGE_TOKENS`` tokens until there are ``MOST_RANGES`` of them.
    """
    spark = docs.sparkSession
    num, den = similarity
    scratch = Scratch(spark, "ngram-join")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks, buckets = max(parts, -(-held // TASK_BYTES)), min(MOST_RANGES, max(64, 4 * parts, held // (TOKEN_BYTES * RANGE_TOKENS)))
    unnamed, rows = rows.where("doc_id is null"), rows.where("doc_id is not null")

    state = scratch.save(_shared_tokens(rows.mapInArrow(_from_texts(n, buckets), ENTRIES), buckets, tasks, num, den), "state")
    near = state.where("toks is not null")
    # A class is a node by its smallest id, or by a hash of its fingerprint if that id stands for several classes.
    rep = near.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    first = rep.groupBy("rep").agg(F.min("fp").alias("first_fp"))
    node = F.when(F.col("fp") == F.col("first_fp"), F.col("rep")).otherwise(F.xxhash64("fp"))
    rep = scratch.save(rep.join(first, "rep").select("fp", "rep", node.alias("class")), "rep")
    # One set of each class; rows of an id with one text hold the same set.
    firsts = near.join(rep.withColumnRenamed("fp", "rep_fp"), (F.col("doc_id") == F.col("rep")) & (F.col("fp") == F.col("rep_fp"))).select(F.col("class").alias("doc_id"), "n_shingles", "fp", "toks")
    sets = scratch.save(_shared_tokens(firsts.mapInArrow(_from_sets(buckets), ENTRIES), buckets, tasks, num, den).where("toks is not null").drop("fp").dropDuplicates(["doc_id"]), "sets")

    if classes is None:
        counts = np.zeros(512, np.int64)
        for r in sets.select("n_shingles", "toks", "dfs").mapInArrow(_frequencies(num, den), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
            counts[r["step"]] = r["n"]
        classes = class_borders(counts)
    sigs = scratch.save(sets.select("doc_id", "n_shingles", "toks", "dfs").mapInArrow(_sign(num, den, list(classes)), SIGS), "sigs")
    if report is not None:
        report.update(classes=list(classes), signatures={r["k"]: r["n"] for r in sigs.groupBy("k").agg(F.count("*").alias("n")).collect()})
    lead = sigs.groupBy("sig").agg(F.min(F.struct("doc_id", "n_shingles")).alias("lead"), F.max("doc_id").alias("last")).where("lead.doc_id < last")
    pairs = (
        sigs.join(lead, "sig").where(F.col("doc_id") != F.col("lead.doc_id"))
        .where((F.col("n_shingles") * num <= F.col("lead.n_shingles") * den) & (F.col("lead.n_shingles") * num <= F.col("n_shingles") * den))
        .select(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    )
    left = sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("toks").alias("toks_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("toks").alias("toks_b"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "toks_a", "toks_b")
    found = scratch.save(compared.mapInArrow(_verify(num, den), "a long, b long, sure boolean"), "found")
    stars = scratch.save(_settled(found, rows, rep, n, num, den, scratch, "found"), "stars")
    comp = connected_components(stars, scratch, "first")

    rest = scratch.save(_rest(sigs, sets, comp, num, den), "rest")
    rest = scratch.save(_settled(rest, rows, rep, n, num, den, scratch, "rest"), "settled")
    same = rep.where(F.col("class") != F.col("rep")).select(F.col("rep").alias("a"), F.col("class").alias("b"))  # classes of one id
    final = connected_components(stars.union(rest).union(same), scratch, "last")
    names = final.join(rep, F.col("node") == F.col("class")).groupBy("comp").agg(F.min("rep").alias("name"))
    final = final.join(names, "comp").select(F.col("node").alias("class"), F.col("name").alias("comp"))
    scratch.drop("sigs", "sets", "found", "found-asked", "stars", "rest", "rest-asked", "settled")

    named = near.select("doc_id", "n_shingles", "fp").join(rep, "fp").join(final, "class", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    # Documents that share too little with any other have no class; joined, they would all meet under one null key.
    named = named.union(state.where("toks is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    lone = unnamed.mapInArrow(_sizes(n), "doc_id long, n_shingles long").withColumn("component_id", F.lit(None).cast("long"))
    return named.union(lone)


def _sizes(n: int):
    def run(batches):
        for ids, sets in shingle_sets(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "n_shingles"])

    return run


def _rest(sigs: DataFrame, sets: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of the signatures that still span several."""
    member = sigs.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("sig", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    # Signatures with the same documents are one; a fingerprint of the documents tells.
    size = member.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    wide = size.groupBy("sig").agg(F.sum("n").alias("docs"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("comps > 1")
    wide = wide.groupBy("docs", "x", "y").agg(F.min(F.struct("sig", "main")).alias("s")).select("s.sig", F.col("s.main.comp").alias("main"), F.col("s.main.n").alias("in_main"), "docs")
    # Documents of the largest component are not compared with each other: they stand against each block of the others.
    few, many = F.ceil((F.col("docs") - F.col("in_main")) / BLOCK_DOCS), F.ceil(F.col("in_main") / BLOCK_DOCS)
    own = F.pmod(F.xxhash64("doc_id"), few)
    other = F.pmod(F.xxhash64("doc_id", F.lit(2)), many)
    cell = lambda i, j, k: (F.least(i, j) * (few + many) + F.greatest(i, j)) * 2 + k
    is_main = F.col("comp") == F.col("main")
    # side 0: the largest component, 1 and 3: two different blocks of others, 2: a block with itself
    against = F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda j: F.struct(cell(own, few + j, 0).alias("part"), F.lit(1).alias("side")))
    between = F.transform(F.sequence(F.lit(0).cast("long"), few - 1), lambda j: F.struct(cell(own, j, 1).alias("part"), F.when(j == own, 2).when(j < own, 1).otherwise(3).alias("side")))
    main_in = F.transform(F.sequence(F.lit(0).cast("long"), few - 1), lambda j: F.struct(cell(j, few + other, 0).alias("part"), F.lit(0).alias("side")))
    placed = member.join(wide, "sig").select("sig", "doc_id", "comp", F.explode(F.when(is_main, main_in).otherwise(F.concat(against, between))).alias("p")).select("sig", "doc_id", "comp", "p.part", "p.side")
    bits = placed.select("doc_id").distinct().join(sets, "doc_id").select("doc_id", "n_shingles", "toks").mapInArrow(_bits, "doc_id long, n_shingles long, n_toks long, bits binary")
    hits = placed.join(bits, "doc_id").groupBy("sig", "part").applyInArrow(_screen(num, den), "sig long, part long, doc_id long, comp long")
    return hits.join(sets.select("doc_id", "n_shingles", "toks"), "doc_id").groupBy("sig", "part").applyInArrow(_exact(num, den), "a long, b long, sure boolean")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id names their component, and those without an id; all columns stay.

    Null, empty and blank texts link with nothing and stay; of rows that repeat
    an id and its text one stays, whichever; different texts of an id that stays
    do; an empty table gives an empty table.
    """
    care, dropped, maybe, rows_of = fresh(docs, "care_id", "dropped_id", "maybe_dropped", "rows_of_id")
    scratch = Scratch(docs.sparkSession, "representatives")
    named = ngram_jaccard_components(docs, id_col, text_col, **how).where("doc_id is not null")
    named = named.groupBy(F.col("doc_id").alias(care)).agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias(dropped), F.count("*").alias(rows_of))
    named = scratch.save(named.where(F.col(dropped) | (F.col(rows_of) > 1)), "named")
    # Most rows surely stay, and stay where they are; the others meet the ids that go.
    own = F.col(id_col).cast("long")
    marked = mark(docs, own, named.select(care), maybe)
    out = marked.where(~F.col(maybe) | own.isNull()).select(*docs.columns)
    met = marked.where(F.col(maybe) & own.isNotNull()).join(named.hint("merge"), own == F.col(care), "left")
    out = out.unionByName(met.where(F.col(care).isNull() | (~F.col(dropped) & (F.col(rows_of) == 1))).select(*docs.columns))
    again = named.where(~F.col(dropped) & (F.col(rows_of) > 1))
    return out if again.isEmpty() else out.unionByName(met.where(~F.col(dropped) & (F.col(rows_of) > 1)).select(*docs.columns).dropDuplicates([id_col, text_col]))
