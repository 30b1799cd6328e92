"""License scans by a positional rare-token index.

The index holds, for each word of the licence templates, its places in them.  A
template's words are ranked by inverse document frequency over the whole corpus;
the postings of the rarest of each, wherever they stand in a file, are shifted by
their place in it and intersected, so that words which stand as they do in a
template meet at one offset.  A template whose mandatory key phrase stands where
that offset puts it is reported.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

# Phrases that are looked for everywhere, with their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Label, text as in the licence's notice, mandatory key phrase within it.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by", "licensed under creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
#: Rarest words of each template that are looked up, and postings that must meet at an offset.
RAREST, MEET = 8, 2


class Index:
    """Places of the templates' words; phrases are templates that are mandatory as a whole."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str, str]]):
        self.entries = [(label, text.split(), 0, len(text.split()), True) for text, label in phrases]
        for label, text, key in templates:
            words, need = text.split(), key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
            self.entries.append((label, words, at, at + len(need), False))
        self.words = sorted({w for e in self.entries for w in e[1]})
        number = {w: i for i, w in enumerate(self.words)}
        self.coded = [np.array([number[w] for w in e[1]]) for e in self.entries]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, codes in enumerate(self.coded):
            for i, c in enumerate(codes.tolist()):
                self.postings[c].append((t, i))
        raw = np.frombuffer("".join(self.words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.words])
        h = T.hashes(raw, ends - [len(w.encode()) for w in self.words], ends)
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those of no template."""
        place = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[place] == h, self.order[place], -1)


def _words(column: pa.Array, index: Index) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, raw, at in T.blocks(column):
        raw = T.LOWER[raw]
        starts, ends = T.spans(raw, at, T.NON_WORD)
        _, word_at = T.owners(starts, at)
        yield first, last, index.codes(T.hashes(raw, starts, ends)), word_at


def _frequencies(index: Index):
    def run(batches):
        df, total = np.zeros(len(index.words), np.int64), 0
        for batch in batches:
            for first, last, codes, word_at in _words(batch.column(0), index):
                held = np.flatnonzero(codes >= 0)
                doc = np.searchsorted(word_at, held, "right") - 1
                df += np.bincount(np.unique(doc * len(index.words) + codes[held]) % len(index.words), minlength=len(index.words))
                total += last - first
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df) + 1) - 1, pa.int64()), pa.array(np.append(total, df), pa.int64())], names=["word", "n"])

    return run


def scan_words(codes: np.ndarray, index: Index, idf: np.ndarray, anchors: list[int], lookup: np.ndarray) -> tuple[list[int], set[str], set[str], float]:
    """Base places, base labels, all labels and score of one text's word numbers."""
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    score = 0.0
    held = np.flatnonzero(codes >= 0)
    for t, anchor in enumerate(anchors):  # a phrase stands only where its rarest word does
        code = index.coded[t]
        at = held[codes[held] == code[anchor]] - anchor
        at = at[(at >= 0) & (at + len(code) <= len(codes))]
        for j in range(len(code)):
            at = at[codes[at + j] == code[j]]
        if len(at):
            places += at.tolist()
            base.add(index.entries[t][0])
            score = 1.0
    met: dict[tuple[int, int], set[int]] = defaultdict(set)
    looked = held[lookup[codes[held]]]
    for p, c in zip(looked.tolist(), codes[looked].tolist()):
        for t, i in index.postings[c]:
            met[t, p - i].add(c)
    for (t, at), which in met.items():
        label, _, key, key_end, phrase = index.entries[t]
        code = index.coded[t]
        if phrase or len(which) < min(MEET, len(set(code.tolist()) & set(np.flatnonzero(lookup).tolist()))):
            continue
        if at + key < 0 or at + key_end > len(codes) or (codes[at + key : at + key_end] != code[key:key_end]).any():
            continue
        low, high = max(0, -at), min(len(code), len(codes) - at)
        same = codes[at + low : at + high] == code[low:high]
        labels.add(label)
        score = max(score, float(idf[code[low:high][same]].sum() / max(idf[code].sum(), 1e-12)))
    return places, base, labels | base, min(score, 1.0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] | None = None, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row of ``docs``.

    ``n_base`` counts all places of the phrases; ``labels`` adds the templates
    found; ``score`` is the largest share of a found template's inverse document
    frequency that the file's words match, 1 for a phrase, 0 for none.  Words of
    equal frequency rank by the alphabet.  Null and wordless texts find nothing;
    texts of any length are read whole, and every rare word in them is looked up;
    an empty table gives an empty table; repeated rows and rows without an id are
    judged one by one; other columns are not read.  Document frequencies
    are counted over all rows; the driver gets one number for each template word.
    """
    index = Index(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    n_phrases = sum(e[4] for e in index.entries)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = {r["word"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies(index), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counted.get(-1, 0)
    idf = np.array([math.log((1 + total) / (1 + counted.get(i, 0))) + 1e-3 for i in range(len(index.words))])
    anchors = [int(np.argmax(idf[c])) for c in index.coded[:n_phrases]]
    lookup = np.zeros(len(index.words), bool)  # the rarest words of each template
    for code in index.coded[n_phrases:]:
        lookup[np.array(sorted(set(code.tolist()), key=lambda c: (-idf[c], c))[:RAREST])] = True
    start = lookup.copy()
    start[[int(index.coded[t][a]) for t, a in enumerate(anchors)]] = True
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, codes, word_at in _words(batch.column(1), index):
                hit = np.flatnonzero((codes >= 0) & start[codes])
                found = [([], set(), set(), 0.0)] * (last - first)
                for d in np.unique(np.searchsorted(word_at, hit, "right") - 1).tolist():
                    found[d] = scan_words(codes[word_at[d] : word_at[d + 1]], index, idf, anchors, lookup)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(np.diff(word_at), pa.int64()), pa.array([len(f[0]) for f in found], pa.int64()),
                    pa.array([min(f[0], default=None) for f in found], pa.int64()), pa.array([max(f[0], default=None) for f in found], pa.int64()),
                    pa.array([",".join(sorted(f[1])) for f in found]), pa.array([",".join(sorted(f[2])) for f in found]), pa.array([f[3] for f in found], pa.float64()),
                ], names=names)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
