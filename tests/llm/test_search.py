"""Ranked search against scores of all documents, and what the index and the bounds do."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from rastrel.llm import lexical_search as S

from ..conftest import DATA

TERM, FOLD = re.compile(S.TERM), str.maketrans(S.UPPER, S.LOWER)


def terms(text):
    return Counter(x.translate(FOLD) for x in TERM.findall(text or ""))


def brute(docs, queries, k):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms, df = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(docs, queries, **how):
    return sorted((tuple(r) for r in S.lexical_search(docs, queries, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{"k": 50}, {"k": 7, "shard_docs": 23, "block_terms": 400}])
def test_whole_tables(spark, how):
    docs, items = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    plain = [[tuple(r) for r in t.collect()] for t in (docs.select("doc_id", "text"), items.select("item_id", "text"))]
    assert got(docs, items, **how) == brute(*plain, how["k"])


def test_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    docs = [(1, None), (2, ""), (3, " ,.!"), (4, "Alpha beta"), (4, "Alpha beta"), (None, "alpha beta"), (5, "ALPHA alpha gamma"), (6, "été Été x"), (7, long), (8, "beta"), (9, "delta_x a-b")]
    items = [(1, "alpha, beta"), (2, None), (3, "none of these"), (4, "Été w3"), (5, "alpha"), (5, "gamma beta"), (None, "a b x"), (6, "w1 w2 beta")]
    made = spark.createDataFrame([(i, t, "clash", 2) for i, t in docs], "doc_id long, text string, term string, score int").repartition(2)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, words string")
    for how in ({"k": 3}, {"k": 50, "shard_docs": 2}):
        assert got(made, asked, **how) == brute(docs, items, how["k"])
    assert got(made.where("doc_id < 0"), asked, k=3) == [] == got(made, asked.where("item_id < 0"), k=3)


def test_varint():
    x = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 32) - 1])
    packed, ends = S.varint(x)
    assert S.unvarint(packed.tobytes()).tolist() == x.tolist() and ends[-1] == len(packed)
    assert S.unvarint(b"").tolist() == []


def test_blocks_are_skipped_and_nothing_is_lost():
    """A rare term decides the first places, so most blocks of a common term are never decompressed."""
    texts = ["rare " * 9 + "common" if k % 1000 == 7 else ("common " if k % 3 else "other ") + "pad " * (k % 50 + 5) for k in range(20_000)]
    data = "".join(texts).encode()
    at = np.cumsum([0, *map(len, texts)])
    n_terms = sum(len(t.split()) for t in texts)
    n, (names, df, top, blocks, postings) = S.shard_lists([S.shard_words(np.frombuffer(data, np.uint8), at)], len(texts), n_terms)
    lists = {name.decode(): S.Postings(*row) for name, *row in zip(names.to_pylist(), df.to_pylist(), top.to_pylist(), blocks.to_pylist(), postings.to_pylist())}
    m, counts = S.length_norm(n, len(texts), n_terms), {}
    asked = [(S.weight(len(texts), lists[t].df), lists[t]) for t in ("rare", "common")]
    place, score = S.best_of_shard(asked, m, 10, 1, counts)
    want = np.zeros(len(texts), np.int64)
    for w, p in asked:
        i, tf = S.Postings(p.df, p.top, p.raw and np.stack([p.firsts, p.tops, p.ends], 1).astype("<u4").tobytes(), p.raw).all()
        want[i] += w * S.impact(tf, m[i])
    best = sorted(zip(-want, range(len(want))))[:10]
    assert sorted(zip(-score, place))[:10] == best
    assert counts["skipped"] > 80
