"""Cross-tokenizer alignment with exact-text deduplication.

Rows are shuffled by their full text, so that each distinct text is tokenised by
both tokenizers and aligned once; how often a token pair is linked in the corpus
is summed with the multiplicity of the texts; the measures are then joined back
to the ids by the text's SHA-256.

Inside a task, a text is cut at single spaces between visible characters.  Both
tokenizers end a token there and take up afresh, so pieces are aligned once and
looked up after that; ``cuts_at_spaces`` verifies the vocabulary for it.

Counts of the commonest pairs, at most ``most_pairs`` of them, are broadcast; the
occurrences of all others are exploded and joined with their counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

#: Pieces a worker keeps, the longest piece that it keeps in bytes, and bytes of text handled at once.
KEPT_PIECES, KEPT_BYTES, BLOCK = 400_000, 200, 1 << 20
#: Pairs whose counts are broadcast at most: 12 bytes each.
MOST_PAIRS = 1 << 19
SPACE = re.compile(r"(?<=\S) (?=\S)")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
TEXTS = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE}
    others = sorted(set(range(256)) - plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def cuts_at_spaces(pieces: list[str]) -> bool:
    """Whether no piece has a space after another character, so that a merge never crosses the start of a word."""
    return not any("▁" in p.lstrip("▁") for p in pieces)


class Aligner:
    """Token ids of both tokenizers, their groups and their links, by piece of text."""

    def __init__(self, model_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(model_a), SentencePieceProcessor(model_proto=model_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        letters = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width, self.by_piece = len(pieces), cuts_at_spaces(pieces)
        self.long_a, self.long_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: An id and what follows it: another of its side, B's part of the group, the next group.
        self.said = np.array([f"{i}{mark}" for i in range(max(len(self.bytes_a), self.width)) for mark in ",|;"], object)
        self.encode_a = self._ranked(model_a) or (lambda text: self.a.encode(text, add_special_tokens=False).ids)
        self._reset()

    def _ranked(self, model_a: str):
        """The same encoding by ``tiktoken``, which is faster, if ids are the order of merges and words are cut as usual; None if not."""
        import public_tokenizers
        import tiktoken

        told = json.loads(model_a)
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        vocabulary, letters = told["model"]["vocab"], byte_alphabet()
        in_order = all(vocabulary.get(x + y) == 256 + k for k, (x, y) in enumerate(merges)) and all(vocabulary.get(c, 256) < 256 for c in letters)
        plain = told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and told["normalizer"] is None
        if not (in_order and plain):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.counts = np.zeros((0, 4), np.int32)
        self.pairs, self.times, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Groups as text (each group closed by ``;``), counts and links of pieces; None and zeros if tokens are not the bytes."""
        wholes = [b" " + p.encode() for p in pieces]
        ours = [self.encode_a(" " + p) for p in pieces]
        theirs = self.b.encode(pieces, num_threads=1)
        spelled = lambda ids, table: b"".join(map(table.__getitem__, chain.from_iterable(ids)))
        joined = b"".join(wholes)
        good = np.ones(len(pieces), bool)
        if spelled(ours, self.bytes_a) != joined or spelled(theirs, self.bytes_b) != joined:
            good = np.array([spelled([x], self.bytes_a) == w == spelled([y], self.bytes_b) for x, y, w in zip(ours, theirs, wholes)])
            ours, theirs = ([ids if g else [] for ids, g in zip(side, good)] for side in (ours, theirs))
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (ours, theirs))
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        owner = np.searchsorted(np.cumsum([len(w) * g for w, g in zip(wholes, good)]), both)
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        four = np.zeros((len(pieces), 4), np.int64)
        for k, n in enumerate((n_a, n_b, np.ones(len(both), np.int64), n_a * n_b)):
            np.add.at(four[:, k], owner, n)

        # A's tokens of a group, then B's, each with what follows it.
        said = np.empty(len(a) + len(b), object)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        said[np.arange(len(a)) + before_b[group_a]] = self.said[a * 3 + last_a]
        said[np.arange(len(b)) + (before_a + n_a)[group_b]] = self.said[b * 3 + last_b * 2]
        said, at = said.tolist(), 0
        for p, ok, n in zip(pieces, good.tolist(), (four[:, 0] + four[:, 1]).tolist()):
            self.number[p] = len(self.groups)
            self.groups.append("".join(said[at : at + n]) if ok else None)
            at += n

        # The different ids of a group on either side, and all pairs of them.
        (a_of, a_id, a_n), (b_of, b_id, b_n) = (self._kinds(g, ids) for g, ids in ((group_a, a), (group_b, b)))
        n_b = np.bincount(b_of, minlength=len(both))
        fan = n_b[a_of]
        left = np.repeat(np.arange(len(a_of)), fan)
        right = np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan) + (np.cumsum(n_b) - n_b)[a_of][left]
        key, inverse = np.unique(owner[a_of[left]] << 32 | a_id[left] * self.width + b_id[right], return_inverse=True)
        times = np.bincount(inverse, weights=a_n[left] * b_n[right], minlength=len(key))
        sizes = np.bincount(key >> 32, minlength=len(pieces))
        self.counts = np.concatenate([self.counts, four.astype(np.int32)])
        self.pairs, self.times, self.sizes = (np.concatenate([x, y.astype(x.dtype)]) for x, y in ((self.pairs, key & 0xFFFFFFFF), (self.times, times), (self.sizes, sizes)))

    @staticmethod
    def _kinds(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = np.unique(group << 32 | ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, n

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the four counts and the groups; of all links the text, the pair and how often, by text and pair."""
        split = [SPACE.split(t) if self.by_piece else [t] for t in texts]
        size = np.array([len(s) for s in split])
        flat = [p for s in split for p in s]
        code = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        lost = np.flatnonzero(code < 0)
        if len(lost):
            missing = [flat[i] for i in lost]
            self._learn(list(dict.fromkeys(missing)))
            code[lost] = [self.number[p] for p in missing]
        owner = np.repeat(np.arange(len(texts)), size)
        counts = np.zeros((len(texts), 4), np.int64)
        np.add.at(counts, owner, self.counts[code])
        names, groups, at, wrong = list(map(self.groups.__getitem__, code.tolist())), [], 0, []
        for t, n in enumerate(size.tolist()):
            own = names[at : at + n]
            at += n
            if None in own:
                wrong.append(t)
                groups.append("")
            else:
                groups.append("".join(own)[:-1])
        counts[wrong] = 0
        # A piece that a text holds many times is looked at once.
        kinds, n = np.unique(owner * len(self.groups) + code, return_counts=True)
        owner, code = kinds // len(self.groups), kinds % len(self.groups)
        right = ~np.isin(owner, wrong)
        owner, code, n = owner[right], code[right], n[right]
        begin, long = (np.cumsum(self.sizes) - self.sizes)[code], self.sizes[code]
        where = np.repeat(begin - (np.cumsum(long) - long), long) + np.arange(long.sum())
        key = np.repeat(owner << 32, long) + self.pairs[where].astype(np.int64)
        found, inverse = np.unique(key, return_inverse=True)
        times = np.bincount(inverse, weights=self.times[where] * np.repeat(n, long), minlength=len(found)).astype(np.int64)
        if len(self.number) > KEPT_PIECES or any(len(flat[i]) > KEPT_BYTES for i in lost):
            self._reset()
        return counts, groups, found >> 32, found & 0xFFFFFFFF, times


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(model_a: str, model_b: bytes) -> Aligner:
    """One for each worker process."""
    key = hashlib.sha256(model_a.encode() + model_b).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(model_a, model_b)
    return _ALIGNERS[key]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _align(models, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(*models.value)
        for batch in batches:
            raw = batch.column(0).cast(pa.binary()).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            first = 0
            while first < len(raw):
                last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
                texts = [x.decode("utf-8", "replace") for x in raw[first:last]]
                counts, groups, owner, pairs, times = coder.align(texts)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                sizes = np.bincount(owner, minlength=last - first)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(c, pa.int64()) for c in counts.T), pa.array(groups, pa.string()), _lists(pairs, sizes), _lists(times, sizes)], names=["key", "copies", *COUNTS, "groups", "pairs", "times"])
                first = last
        T.trim()

    return run


def _look_up(table, width: int):
    """The part of the measures that broadcast counts give, and the pairs that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            own, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            known = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            n = np.where(known, counts[at], 0) if len(pairs) else np.zeros(len(own), np.int64)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, np.where(known & (n == best[own // width]), times, 0))
            np.add.at(sums[1], row, n * times)
            sizes = np.bincount(row[~known], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.int64()) for s in sums), _lists(own[~known], sizes), _lists(times[~known], sizes)], names=["key", "n_best", "count_sum", "pairs", "times"])

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS, digest: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` for each row of ``docs``.

    ``path_a`` is a byte-level tokenizer (``tokenizers``), ``path_b`` a piece model
    (``sentencepiece``); both see a space and then the whole text, without special
    tokens.  ``groups`` lists the ids between places where tokens of both end,
    ``a1,a2|b1;a3|b2,b3``, or its SHA-256 with ``digest`` (the lists are several
    times as long as the texts).  A pair of ids counts once for each row whose
    text links it; ``count_sum`` adds those counts over all links of a text and
    ``n_best`` is the number of its links whose count is the highest of their A
    id, ties included.

    Null and empty texts, and texts that the tokens of either side do not spell
    byte by byte, have no tokens: zeros and an empty ``groups``.  Equal texts are
    aligned once and counted as often as they stand in the table, whatever their
    ids; a row of any id, null or repeated, gives a row.  An empty table gives an
    empty table.  Texts may have any length: a task holds one whole.  Other
    columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        models = (a.read(), b.read())
    width = aligner(*models).width
    shared = spark.sparkContext.broadcast(models)  # vocabulary files, of fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = rows.where("text <> ''")
    each = told.groupBy("text").agg(F.count("*").alias("copies")).select("text", F.unhex(F.sha2("text", 256)).alias("key"), "copies")
    texts = scratch.save(each.mapInArrow(_align(shared, digest), TEXTS), "texts")

    counts = texts.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("n"))
    counts = scratch.save(counts, "counts")
    steps = {r["step"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, held = 64, 0
    while least > 0 and held + steps.get(least - 1, 0) <= most_pairs:
        least -= 1
        held += steps.get(least, 0)
    common = F.floor(F.log2("n")) >= least
    best = np.zeros(1 << 22, np.int64)  # one for each A id
    for ids in counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("n")).toArrow().to_batches():
        best[ids.column(0).to_numpy()] = ids.column(1).to_numpy()
    few = counts.where(common).toArrow()  # at most most_pairs
    pairs = few["pair"].to_numpy().astype(np.int64)
    order = np.argsort(pairs)
    best = best[: int(np.flatnonzero(best).max(initial=0)) + 1]
    table = spark.sparkContext.broadcast((pairs[order], few["n"].to_numpy().astype(np.int64)[order], best))

    part = texts.select("key", "pairs", "times").mapInArrow(_look_up(table, width), "key binary, n_best long, count_sum long, pairs array<int>, times array<int>")
    if held == sum(steps.values()):
        sums = part.select("key", "n_best", "count_sum")
    else:
        part = scratch.save(part, "part")
        top = spark.createDataFrame([(int(i), int(best[i])) for i in np.flatnonzero(best)], "a int, top long")
        rare = counts.where(~common).withColumn("a", F.expr(f"cast(pair div {width} as int)")).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
        rest = part.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        rest = rest.join(rare, "pair").select("key", F.when(F.col("is_best"), F.col("times")).otherwise(0).cast("long").alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
        sums = part.select("key", "n_best", "count_sum").unionByName(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = scratch.save(texts.drop("copies", "pairs", "times").join(sums, "key"), "measures")
    scratch.drop("texts", "counts", "part")

    out = ["doc_id", *COUNTS, "n_best", "count_sum", "groups"]
    named = told.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key")).join(measures, "key").select(*out)
    # Rows without text would all meet under one key, so they are not joined.
    blank = rows.where("text is null or text = ''").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in out[1:-1]), F.lit("").alias("groups"))
    return named.unionByName(blank)
