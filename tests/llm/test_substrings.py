"""Repeated strings of 200 bytes against plain Python, through every way of the operator."""

import random
from collections import Counter

import numpy as np
import pytest

from rastrel.llm import substrings
from rastrel.llm.substrings import Collision, Prefixes, Suffixes, dedup_substrings

from ..conftest import DATA


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                hit[p : p + length] = b"\1" * length
        edges = [p for p in range(len(b) + 1) if (p < len(b) and hit[p]) != (p > 0 and hit[p - 1])]
        out.append((len(b), list(zip(edges[::2], edges[1::2])), bytes(x for x, h in zip(b, hit) if not h)))
    return out


def got(df, **how):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in dedup_substrings(df, **how).collect()), key=repr)


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = [None, "", "short", "x" * 150, "y" * 199, "y" * 200, "z" * 201, "q" * 700, "ab" * 300, "ab" * 101]
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 40)))
        for _ in range(rng.randint(0, 3)):
            x = rng.choice(passages)
            if rng.random() < 0.5:
                i = rng.randrange(len(x))
                x = x[:i] + rng.choice(["", "Q", "xyz"]) + x[i + rng.randint(0, 2) :]
            t += x + " ".join(word() for _ in range(rng.randint(0, 20)))
        texts.append(t)
    texts += [texts[20]] * 5 + [passages[0]] * 3 + [texts[30][3:]]
    return [(None if i == 12 else i // 2 if i > 70 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("how", [{}, {"most": 2, "bucket_bytes": 2000, "bitmap_log": 15}])
def test_spans_and_bytes(spark, how):
    docs = planted()
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, kmer int, key string").repartition(3)
    assert got(df, **how) == sorted(((i, *x) for (i, _), x in zip(docs, brute([t for _, t in docs]))), key=repr)


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    assert got(table) == sorted(((i, *x) for (i, _), x in zip(docs, brute([t for _, t in docs]))), key=repr)


def test_long_text_and_empty_table(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij ") for _ in range(600_000))
    df = spark.createDataFrame([(1, long), (2, long[500_000:500_300]), (3, "a" * 50_000)], "doc_id long, text string")
    rows = {i: (n, spans) for i, n, spans, _ in got(df)}
    assert rows == {1: (600_000, [(500_000, 500_300)]), 2: (300, [(0, 300)]), 3: (50_000, [(0, 50_000)])}
    assert got(df.where("doc_id < 0")) == []


def test_suffix_sort_is_that_of_the_bytes():
    rng = random.Random(1)
    data = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(400)]
    raw, size = np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data])
    begin, group = np.cumsum(size) - size, np.array([rng.randrange(5) for _ in data])
    for backwards in (False, True):
        own = Suffixes(raw, Prefixes(raw, 3), begin + size if backwards else begin, size, group, backwards)
        read = [d[::-1] if backwards else d for d in data]
        assert [(group[i], read[i]) for i in own.order] == sorted(zip(group, read))


def test_collisions_are_found(monkeypatch):
    class Blind(Prefixes):
        def of(self, first, last):
            return np.zeros(len(first), np.uint64)

    raw = np.frombuffer(b"abcdabce", np.uint8)
    at, size, group = np.array([0, 4]), np.array([4, 4]), np.zeros(2, np.int64)
    with pytest.raises(Collision):
        Suffixes(raw, Blind(raw, 1), at, size, group, False)
    monkeypatch.setattr(substrings, "Prefixes", lambda raw, seed: (Blind if seed == 11 else Prefixes)(raw, seed))
    data = [b"u" * 90 + b"k" * 32 + b"v" * 200, b"w" * 90 + b"k" * 32 + b"v" * 200]
    first, last = substrings.repeated_windows(data, np.zeros(2, np.int64), np.array([90, 90]), np.array([123, 123]), np.zeros(2, np.int64), np.full(2, 168), 200)
    assert first.tolist() == [90, 90] and last.tolist() == [90, 90]
