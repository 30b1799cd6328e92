"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Percent of a text's word characters that may lie in n-grams found twice or more, by n-gram length.
MOST_COVERED = {5: 20, 7: 18, 10: 16}
#: Percent of a text's word characters that may lie in lines equal to an earlier one.
MOST_LINES = 30
LEAST_WORDS = 10

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that ``at`` bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    place = np.searchsorted(twice, keys)
    place[place == len(twice)] = 0
    return twice[place] == keys


def measure(raw: np.ndarray, at: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text of a block."""
    texts = len(at) - 1
    starts, ends = T.spans(raw, at, T.SPACES)
    h = T.hashes(raw, starts, ends)
    n_words, word_at = T.owners(starts, at)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[ends] - points[starts]
    char_at = np.concatenate([[0], np.cumsum(chars)])
    out = {"n_words": n_words, "word_chars": np.diff(char_at[word_at]), "n_symbols": _by_text(SYMBOLS[raw], at)}
    owner = np.repeat(np.arange(texts, dtype=np.uint64), n_words)
    for n in lengths:
        g, begin, _ = T.grams(h, word_at, n)
        with np.errstate(over="ignore"):
            twice = begin[repeated(T.mix(g + owner[begin] * T._P))]
        depth = np.bincount(twice, minlength=len(h) + 1)[: len(h) + 1] - np.concatenate([np.zeros(n, np.int64), np.bincount(twice, minlength=len(h) + 1)])[: len(h) + 1]
        covered = np.cumsum(depth)[: len(h)] > 0
        if n == 5:
            out["n_repeat_words"] = _by_text(covered, word_at)
        out[f"dup_chars_{n}"] = _by_text(np.where(covered, chars, 0), word_at)
    breaks = np.flatnonzero(raw == 0x0A)
    begins = np.unique(np.concatenate([at[:-1], breaks + 1]))
    begins = begins[begins < len(raw)]
    stops = at[np.searchsorted(at, begins, "right")]
    broken = np.append(breaks, len(raw))[np.searchsorted(breaks, begins)]
    stops = np.minimum(stops, broken)
    first, last = np.searchsorted(starts, begins), np.searchsorted(starts, stops)
    full = last > first
    begins, stops, first, last = begins[full], stops[full], first[full], last[full]
    line_of = np.searchsorted(at, begins, "right") - 1
    order = np.lexsort((np.arange(len(begins)), T.hashes(raw, begins, stops), line_of))
    lines, of = T.hashes(raw, begins, stops)[order], line_of[order]
    again = order[1:][(lines[1:] == lines[:-1]) & (of[1:] == of[:-1])]
    out["n_dup_lines"] = np.bincount(line_of[again], minlength=texts)
    out["dup_line_chars"] = np.bincount(line_of[again], weights=char_at[last[again]] - char_at[first[again]], minlength=texts).astype(np.int64)
    return out


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_covered: dict[int, int] | None = None, most_lines: int = MOST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """Counts and verdict for each row of ``docs``, under its id as ``doc_id``.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the
    characters in duplicated n-grams and lines; ``base_failed``: fewer than
    ``least_words`` words or over 20 % of words in repeated 5-word windows;
    ``kept``: not ``base_failed`` and no coverage over its limit; a coverage at
    its limit is kept.  Null, empty and blank texts count nothing and fail; texts
    of any length are counted whole, one block of them or one longer text at a
    time; an empty table gives an empty table; repeated rows and rows without an
    id are judged one by one; other columns are not read.
    """
    limits = MOST_COVERED if most_covered is None else most_covered
    lengths = tuple(sorted({5, *limits}))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, at in T.blocks(batch.column(1)):
                got = measure(raw, at, lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(got[x], pa.int64()) for x in names)], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))
    bad = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = out.withColumn("base_failed", bad)
    over = F.col("dup_line_chars") * 100 > F.col("word_chars") * most_lines
    for n, most in limits.items():
        over = over | (F.col(f"dup_chars_{n}") * 100 > F.col("word_chars") * most)
    return out.withColumn("kept", ~F.col("base_failed") & ~over)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that ``quality_metrics`` keeps, with all their columns, in one scan.

    Null, empty and blank texts go; rows that repeat an id, or have none, are
    judged one by one; an empty table gives an empty table.
    """
    columns = limits.pop("most_covered", None) or MOST_COVERED
    most_lines, least_words = limits.pop("most_lines", MOST_LINES), limits.pop("least_words", LEAST_WORDS)
    lengths, place = tuple(sorted({5, *columns})), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for _, _, raw, at in T.blocks(batch.column(place)):
                m = measure(raw, at, lengths)
                ok = (m["n_words"] >= least_words) & (m["n_repeat_words"] * 100 <= m["n_words"] * 20) & (m["dup_line_chars"] * 100 <= m["word_chars"] * most_lines)
                for n, most in columns.items():
                    ok &= m[f"dup_chars_{n}"] * 100 <= m["word_chars"] * most
                keep.append(ok)
            yield batch.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)])))
        T.trim()

    return docs.mapInArrow(run, docs.schema)
