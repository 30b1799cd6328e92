"""Ranked lexical search: an inverted index by shard, searched by Block-Max MaxScore.

Tasks that scan the documents cut them into shards of whole texts and write for
each term of a shard its postings in blocks of ``BLOCK`` documents, compressed,
with the largest impact of each block and of the list.  A search reads the lists
of the queries' terms alone, shard by shard:

* terms are taken by falling global bound (weight times the list's largest
  impact) while the bounds of the rest could still lift a new document into the
  first ``k``; these lists are essential and are read whole;
* the other lists are looked up for candidates only.  A candidate whose score so
  far, the maximum of the block it would stand in and the bounds of the lists
  after that cannot reach the ``k``-th score is dropped, and only blocks in
  which candidates are left are decompressed;
* every task hands the ``k``-th scores on from shard to shard; what the shards
  found is merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

#: Documents of a block, and bytes of text and number of texts of a shard.
BLOCK, SHARD_BYTES, SHARD_DOCS = 128, 8 << 20, 1 << 16
#: Query terms whose weights are broadcast at most; more are joined by a shuffle.
MOST_TERMS = 1 << 20
#: Delimiter bytes of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A row with a null term holds the documents of its shard: ids and lengths.
INDEX = "shard string, term binary, df int, top int, blocks binary, postings binary, ids array<long>, lengths binary"
KINDS = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
NAMES = [c.split()[0] for c in INDEX.split(", ")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's occurrences count before its weight, in whole numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return 50 + (50 * n * docs) // max(terms, 1)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# ---------------------------------------------------------------- index


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for _, _, raw, at in T.blocks(batch.column(0)):
            n, _ = T.owners(T.spans(raw, at, OUTSIDE)[0], at)
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2^35 in one byte for each 7 bits, the last one marked by its high bit; and where each ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[end[has] - size[has] + k] = (values[has] >> 7 * k) & 127
    out[end - 1] |= 128
    return out, end


def unvarint(raw: bytes | memoryview) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data & 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    k = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * k), first)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def shard_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block of texts the lowered bytes, the number of terms of each text, and of each term its start, end and hash."""
    text = T.LOWER[raw]
    starts, ends = T.spans(raw, at, OUTSIDE)
    return text, T.owners(starts, at)[0], starts, ends, T.hashes(text, starts, ends)


def shard_lists(blocks_of: list[tuple[np.ndarray, ...]], docs: int, terms: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The number of terms of each text of a shard, and of each different term ``term, df, top, blocks, postings``.

    A block is the gaps of its documents, the first one counted from 0, and then
    their term frequencies.  ``blocks`` has three numbers for each block of a list
    of several: first document, largest impact, end in ``postings``.
    """
    base = np.cumsum([0, *(len(b[0]) for b in blocks_of)])
    text, n, h = (np.concatenate([b[k] for b in blocks_of]) for k in (0, 1, 4))
    starts, ends = (np.concatenate([b[k] + at for b, at in zip(blocks_of, base)]) for k in (2, 3))
    if not len(starts):
        return n, [pa.array([], k) for k in KINDS[1:6]]
    m = length_norm(n, docs, terms)
    order = np.argsort(h, kind="stable")  # within a term by text
    doc, h = np.repeat(np.arange(len(n)), n)[order], h[order]
    new_term = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    place = np.flatnonzero(new)
    tf, doc = np.diff(np.append(place, len(h))), doc[place]
    begins = np.flatnonzero(new_term[place])  # the first posting of each term
    df = np.diff(np.append(begins, len(doc)))
    opens = np.flatnonzero((np.arange(len(doc)) - np.repeat(begins, df)) % BLOCK == 0)
    size = np.diff(np.append(opens, len(doc)))
    gap = np.diff(doc, prepend=0)
    gap[opens] = doc[opens]
    both = np.empty(2 * len(doc), np.int64)
    where = np.arange(len(doc)) + np.repeat(opens, size)
    both[where], both[where + np.repeat(size, size)] = gap, tf
    packed, ends_of = varint(both)
    tops = np.maximum.reduceat(impact(tf, m[doc]), opens)
    blocks = -(-df // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    block_end = ends_of[2 * (opens + size) - 1]
    list_end = block_end[first_block + blocks - 1]
    three = np.stack([doc[opens], tops, block_end - np.repeat(list_end - np.diff(list_end, prepend=0), blocks)], 1).astype("<u4")
    several = np.repeat(blocks > 1, blocks)
    word = order[place[begins]]
    long = ends[word] - starts[word]
    letters = text[np.repeat(starts[word] - (np.cumsum(long) - long), long) + np.arange(long.sum())]
    return n, [
        _binary(letters, np.cumsum(long)), pa.array(df, pa.int32()), pa.array(np.maximum.reduceat(tops, first_block), pa.int32()),
        _binary(three[several].view(np.uint8).ravel(), np.cumsum(np.where(blocks > 1, 12 * blocks, 0))), _binary(packed, list_end),
    ]


def _index(docs: int, terms: int, most_bytes: int, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, seq = task.partitionId() if task else 0, 0
        ids: list = []
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> Iterator[pa.RecordBatch]:
            n, lists = shard_lists(held, docs, terms)
            shard = f"{part:08d}-{seq:08d}"
            whole = [pa.nulls(1, k) for k in KINDS[1:6]]
            for own, left in ((whole, [pa.array([ids], KINDS[6]), pa.array([n.astype("<i8").tobytes()], KINDS[7])]), (lists, [pa.nulls(len(lists[0]), k) for k in KINDS[6:]])):
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(own[0]), pa.string()), *own, *left], names=NAMES)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, raw, at in T.blocks(batch.column(1), min(T.BLOCK_BYTES, most_bytes)):
                if ids and (len(ids) + last - first > most_docs or sum(len(b[0]) for b in held) + len(raw) > most_bytes):
                    yield from close()
                    ids, held, seq = [], [], seq + 1
                ids += names[first:last]
                held.append(shard_words(raw, at))
        if ids:
            yield from close()
        T.trim()

    return run


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, int, int]:
    """The index of all rows of ``docs``, written in the shared folder, the number of texts with a term and of all terms."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = rows.select("text").mapInArrow(_lengths, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = told["docs"] or 0, told["terms"] or 0
    index = rows.mapInArrow(_index(n_docs, n_terms, shard_bytes, shard_docs), INDEX)
    return scratch.save(index, "index"), n_docs, n_terms


# ---------------------------------------------------------------- search


class Postings:
    """One list of a shard; blocks are decompressed when they are asked for."""

    def __init__(self, df: int, top: int, blocks: bytes, raw: bytes):
        self.df, self.top, self.raw = df, top, raw
        three = np.frombuffer(blocks, "<u4").astype(np.int64).reshape(-1, 3) if blocks else np.array([[0, top, len(raw)]])
        self.firsts, self.tops, self.ends = three.T
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places of documents in the shard, and how often the term stands in them."""
        if b not in self.read:
            both = unvarint(self.raw[self.ends[b - 1] if b else 0 : self.ends[b]])
            half = len(both) // 2
            self.read[b] = np.cumsum(both[:half]), both[half:]
        return self.read[b]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return self.some(range(len(self.firsts)))

    def some(self, blocks) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(b) for b in blocks]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def best_of_shard(lists: list[tuple[int, Postings]], m: np.ndarray, k: int, least: int, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(places, scores)`` of all documents of a shard that may be among the first ``k`` of the query.

    ``lists`` are the query's weights and postings.  A score below ``least``, the
    k-th of other shards, is out; an equal one stays, as ids decide then.
    """
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: (-x[0] * x[1].top, x[1].df))
    bounds = [w * p.top for w, p in lists]
    rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]]).astype(np.int64)  # of a list and all after it
    score, least = np.zeros(len(m), np.int64), max(least, 1)
    seen = np.zeros(len(m), bool)
    at = 0
    while at < len(lists) and rest[at] >= least:  # essential: a document in none of the lists before could still get in
        w, p = lists[at]
        place, tf = p.all()
        score[place] += w * impact(tf, m[place])
        seen[place] = True
        at += 1
        if seen.sum() >= k:
            held = score[seen]
            least = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
    left = np.flatnonzero(seen & (score + rest[at] >= least))
    for i in range(at, len(lists)):  # looked up for candidates only
        w, p = lists[i]
        block = np.searchsorted(p.firsts, left, "right") - 1
        most = np.where(block >= 0, w * p.tops[np.maximum(block, 0)], 0)
        stays = score[left] + most + rest[i + 1] >= least
        left, block = left[stays], block[stays]
        needed = np.unique(block[block >= 0]).tolist()
        if counts is not None:
            counts["skipped"] = counts.get("skipped", 0) + len(p.firsts) - len(needed)
        place, tf = p.some(needed)
        where = np.minimum(np.searchsorted(place, left), max(len(place) - 1, 0))
        hit = place[where] == left if len(place) else np.zeros(len(left), bool)
        score[left[hit]] += w * impact(tf[where[hit]], m[left[hit]])
        if len(left) >= k:
            held = score[left]
            least = max(least, int(np.partition(held, len(held) - k)[len(held) - k]))
        left = left[score[left] + rest[i + 1] >= least]
    left = left[score[left] >= least]
    return left, score[left]


def _search(queries, docs: int, terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, of_term = queries.value  # the items' ids; of each term the weight and the items
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in items]  # score, and the id's order reversed
        lists: dict[bytes, Postings] = {}
        shard, ids, m = None, None, None

        def close() -> None:
            if shard is None:
                return
            own: dict[int, list] = {}
            for term, postings in lists.items():
                w, wanted = of_term[term]
                for q in wanted:
                    own.setdefault(q, []).append((w, postings))
            for q, held in own.items():
                heap = heaps[q]
                place, score = best_of_shard(held, m, k, heap[k - 1][0] if len(heap) >= k else 1)
                heap += [(s, ids[p]) for p, s in zip(place.tolist(), score.tolist())]
                heap.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
                del heap[k:]

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, lists, ids, m = row["shard"], {}, None, None
                if row["term"] is None:
                    ids, m = row["ids"], length_norm(np.frombuffer(row["lengths"], "<i8"), docs, terms)
                else:
                    lists[row["term"]] = Postings(*(row[c] for c in ("df", "top", "blocks", "postings")))
        close()
        out = [(items[q], i, s) for q, heap in enumerate(heaps) for s, i in heap]
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])
        T.trim()

    return run


def search(spark: SparkSession, index: DataFrame, n_docs: int, n_terms: int, queries: DataFrame, k: int, item_col: str = "item_id", text_col: str = "text", block_terms: int = MOST_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the first ``k`` documents of each query, as in ``lexical_search``."""
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = queries.select(F.col(item_col).cast("long").alias("item_id"), F.explode(words).alias("term")).distinct().groupBy("item_id").agg(F.collect_list("term").alias("words"))
    # Queries in blocks of bounded size: the terms of one block are held by every task.
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_terms) or 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        rows = [(r["item_id"], r["words"]) for r in asked.where(F.col("block") == b).select("item_id", "words").collect()]
        wanted: dict[bytes, list[int]] = {}
        for q, (_, own) in enumerate(rows):
            for t in own:
                wanted.setdefault(t.encode(), []).append(q)
        names = spark.createDataFrame([(t,) for t in wanted], "term binary")
        terms = index.join(F.broadcast(names), "term").select(*index.columns)
        df = {bytes(r["term"]): r["df"] for r in terms.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        table = spark.sparkContext.broadcast(([i for i, _ in rows], {t: (weight(n_docs, df[t]), qs) for t, qs in wanted.items() if t in df}))
        shards = terms.unionByName(index.where("term is null")).repartition("shard").sortWithinPartitions("shard")
        found = found.unionByName(shards.mapInArrow(_search(table, n_docs, n_terms, k), "item_id long, doc_id long, score long"))
    # Heaps of the tasks: first some of them together, then all.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, block_terms: int = MOST_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` rows of ``docs`` with the highest scores above 0 for each query.

    Terms are runs of letters and digits, A-Z lowered; anything outside ASCII
    counts as a letter.  A query's terms count once each, and rows of one
    ``item_col`` are one query.  Equal scores stand by ascending id, null ids
    last; a row that repeats an id is a document of its own.  Null texts and texts
    without a term match nothing and are not counted; a query without a term, or
    one whose terms no document has, gives no row; an empty table gives none.
    Texts may have any length: a shard has ``shard_bytes`` of whole texts, or one
    longer text, and ``shard_docs`` texts at most.  Other columns are not read.
    Queries are answered in blocks of about ``block_terms`` terms, so that what a
    task holds does not grow with their number.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    index, n_docs, n_terms = build_index(docs, scratch, id_col, text_col, shard_bytes, shard_docs)
    return search(spark, index, n_docs, n_terms, queries, k, item_col, item_text_col, block_terms)
