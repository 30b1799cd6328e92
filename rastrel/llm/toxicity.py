"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams of the lower-cased text that a document
holds at all.  The log ratio of a feature's smoothed counts in the two classes,
taken over all labelled rows, scales it; a logistic regression on the scaled
features of the most telling n-grams, fitted on a bounded sample of the labelled
rows, gives the weights.  Scoring looks every n-gram up in one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

#: Lengths of n-grams in characters, and the slots that they hash to; the tables of a model have this size.
LENGTHS, SLOTS = (4, 5, 6), 1 << 18
#: Labelled rows that the regression may see (the smallest hashes of their ids), and n-grams that keep a weight.
MOST_ROWS, MOST_FEATURES = 12_000, 6_000
SMOOTH, RIDGE, STEPS = 1.0, 1e-4, 300


def lowered(column: pa.Array) -> pa.Array:
    """The texts in lower case, in every alphabet; null is empty."""
    return pc.utf8_lower(column.fill_null(""))


def features(raw: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The sorted distinct feature slots of each text of a block of lower-cased texts; only those that ``keep`` marks.

    An n-gram is the bytes from one character to the nth after it, so it never cuts one in two.
    """
    first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters start, and the end
    char_at = np.searchsorted(first, at)
    slots = [(T.hashes(raw, first[: max(len(first) - n, 0)], first[n:]) & T.U64(SLOTS - 1)).astype(np.int32) for n in LENGTHS]
    if keep is None:
        for i in range(len(at) - 1):
            yield np.unique(np.concatenate([s[char_at[i] : max(char_at[i], char_at[i + 1] - n + 1)] for s, n in zip(slots, LENGTHS)]))
        return
    kept = []
    for s, n in zip(slots, LENGTHS):
        place = np.flatnonzero(keep[s])
        doc = np.searchsorted(char_at, place, "right") - 1
        inside = place + n <= char_at[doc + 1]
        kept.append(doc[inside].astype(np.int64) * SLOTS + s[place[inside]])
    both = np.unique(np.concatenate(kept))
    cut = np.searchsorted(both, np.arange(len(at), dtype=np.int64) * SLOTS)
    for i in range(len(at) - 1):
        yield both[cut[i] : cut[i + 1]] - i * SLOTS


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slot, none, toxic)``: texts of each class that hold the slot; the texts themselves under slot -1."""
    counts, rows = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for first, _, raw, at in T.blocks(lowered(batch.column(0))):
            for i, slots in enumerate(features(raw, at)):
                counts[int(y[first + i]), slots] += 1
                rows[int(y[first + i])] += 1
    held = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), *(pa.array(np.append(c[held], n)) for c, n in zip(counts, rows))], names=["slot", "none", "toxic"])


def _design(keep: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s.astype(np.int32).tobytes() for _, _, raw, at in T.blocks(lowered(batch.column(0))) for s in features(raw, at, keep)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], names=["y", "slots"])

    return run


def fit_weights(y: np.ndarray, rows: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by slot, the ratios multiplied in, and the intercept; accelerated gradient steps on the logistic loss."""
    used, column = np.unique(np.concatenate([*rows, np.zeros(0, np.int32)]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    owner = np.repeat(np.arange(len(rows)), np.diff(at))
    x = ratio[used][column]
    # Classes weigh the same in the loss, and are set back by the intercept.
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    size = np.bincount(owner, weights=x * x, minlength=len(rows))
    rate = 4.0 / max(float(np.quantile(size, 0.99)) if len(size) else 1.0, 1.0)
    w, b, pw, pb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for k in range(STEPS):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        z = np.bincount(owner, weights=x * vw[column], minlength=len(rows)) + vb
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        pw, pb = w, b
        w = vw - rate * (np.bincount(column, weights=x * miss[owner], minlength=len(used)) + RIDGE * vw)
        b = vb - rate * miss.sum()
    out = np.zeros(SLOTS, np.float64)
    out[used] = w * ratio[used]
    return out, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, scratch: Scratch | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept: log-count ratios of all labelled documents, a regression on at most ``most_rows`` of them.

    Null labels are left out; a document with several labels is toxic if one
    says so, and of one with several texts the smallest is taken; ids of equal
    hash are sampled by the id.  Without rows of both classes all weights are 0
    and the intercept gives the share of toxic rows (one half if there are none).
    The driver gets a row for each of the ``SLOTS`` n-grams, and for each sampled
    document the n-grams among the ``most_features`` kept that it holds.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.least(F.max(F.col(label_col).cast("int")), F.lit(1)).alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    # Rows of one id become one before they count: repeated ids neither weigh more nor enlarge the sample.
    of = lambda ids: texts.join(ids, "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    told = of(named).mapInArrow(_class_counts, "slot long, none long, toxic long").groupBy("slot").agg(F.sum("none").alias("none"), F.sum("toxic").alias("toxic")).toPandas()
    rows = told.loc[told.slot < 0, ["none", "toxic"]].sum().to_numpy(float)
    counts, told = np.zeros((2, SLOTS)), told[told.slot >= 0]
    counts[0, told.slot], counts[1, told.slot] = told.none, told.toxic
    if not rows.all():
        share = (rows[1] + 1) / (rows.sum() + 2)
        return np.zeros(SLOTS), float(np.log(share / (1 - share)))
    p, q = (counts[1] + SMOOTH) / (rows[1] + 2 * SMOOTH), (counts[0] + SMOOTH) / (rows[0] + 2 * SMOOTH)
    ratio = np.log(p / q)
    # The features that tell most: ratio times the standard error's inverse, on both sides.
    telling = np.abs(ratio) / np.sqrt(1 / (counts[1] + SMOOTH) + 1 / (counts[0] + SMOOTH))
    telling[counts.sum(0) < 3] = 0
    keep = np.zeros(SLOTS, bool)
    keep[np.argsort(-telling, kind="stable")[:most_features]] = True
    keep &= telling > 0
    chosen = named.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)  # so bounded, it may be broadcast
    sample = scratch.save(of(F.broadcast(chosen)), "sample")
    got = sample.mapInArrow(_design(keep), "y int, slots binary").collect()
    return fit_weights(np.array([r["y"] for r in got]), [np.frombuffer(r["slots"], np.int32) for r in got], ratio)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, **fit) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Labels of documents whose crc32 of the id as text leaves 1 when divided by 3
    are never seen.  Null and empty texts get the score of no features; texts of
    any length are scored whole; a null id is not held out; an empty table gives
    an empty table; repeated rows are scored one by one, alike; a document's other
    columns are not read.  ``fit``: ``most_rows`` and ``most_features`` of ``train``.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 3 == 1, F.lit(False))
    weights, bias = train(docs, labels.where(~held), id_col, text_col, label_col, **fit)
    keep, table = weights != 0, weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, at in T.blocks(lowered(batch.column(2))):
                z = np.array([table[s].sum() for s in features(raw, at, keep)]) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                n = last - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
