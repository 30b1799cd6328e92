"""Mixing against plain Python, and its rows in and out for repeated and null keys."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rastrel.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_id int"


def _plain(rows, target, repeats, share, seed=0):
    """{(doc_id, source): copies} for rows of (doc_id, source, n, place, turn by block and epochs)."""
    tokens, docs = defaultdict(int), defaultdict(int)
    for _, source, n, _, _ in rows:
        tokens[source] += n
        docs[source] += 1
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def fits(a):
        w = weights(a)
        if target is not None:
            return -sum(x * math.log(x) for x in w.values()) >= target * math.log(len(p))
        top = max(w[s] / p[s] for s in p)
        return not top * (share if share else 1 / min(w[s] / p[s] for s in p)) <= repeats

    low, high = 0.0, 1.0
    if fits(1.0):
        low = 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    a = low if target is not None else high
    w = weights(a)
    share = share or 1 / min(w[s] / p[s] for s in p)
    out = {}
    for s in p:
        reads = round(w[s] / p[s] * share, 9)
        epochs, rest = math.floor(reads), math.floor((reads - math.floor(reads)) * tokens[s])
        blocks = defaultdict(list)
        for d, source, n, place, turns in rows:
            if source == s:
                blocks[place % math.ceil(docs[s] / mixing.BLOCK_DOCS)].append((place, d, n, turns))
        for b in sorted(blocks, key=lambda b: blocks[b][0][3](s, b, epochs)):
            members = sorted(blocks[b], key=lambda m: m[:2])
            whole = sum(m[2] for m in members)
            room = rest
            for _, d, n, _ in members:
                room -= n
                out[d, s] = epochs + (whole <= rest or (rest > 0 and room >= 0))
            rest -= whole
    return out


@pytest.mark.parametrize("target,repeats,share", [(0.9, None, 1.0), (None, 1.5, None), (None, 3.0, 1.0)])
def test_copies_are_those_of_plain_python(spark, target, repeats, share):
    docs = spark.createDataFrame([(k, "w " * (3 + k * k % 11), "big" if k < 2500 else f"s{k % 4}", 0) for k in range(4000)], SCHEMA).repartition(5)
    got = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix_sources(docs, target_entropy=target, most_repeats=repeats, budget_share=share).collect()}
    turns = {}
    wide = spark.range(12).select(F.col("id").alias("block")).crossJoin(spark.range(5).select(F.col("id").alias("epochs"))).crossJoin(docs.select("source").distinct())
    for r in wide.select("source", "block", "epochs", F.xxhash64("source", "block", "epochs", F.lit(1)).alias("h")).collect():
        turns[r["source"], r["block"], r["epochs"]] = r["h"]
    rows = [(r["doc_id"], r["source"], len(r["text"].split()), r["h"], lambda *k: turns[k]) for r in docs.select("*", F.xxhash64("doc_id", F.lit(0)).alias("h")).collect()]
    assert got == _plain(rows, target, repeats, share)


def test_rows_in_and_out(spark):
    rows = [(None, f"text {k}", "a", 1) for k in range(20)] + [(None, "same", "a", 1)] * 30 + [(7, "one", "a", 1)] * 50 + [(7, "two", None, 1)] * 5 + [(k, "w " * 9, "b", 1) for k in range(100, 130)] + [(8, None, "a", 1), (9, "", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    every = mixing.realise(docs, most_repeats=1.0, budget_share=None)
    assert every.columns == docs.columns and sorted(map(tuple, every.collect()), key=repr) == sorted(rows, key=repr)
    more = mixing.realise(docs, most_repeats=1.5, budget_share=None)
    assert len(rows) <= more.count() <= 1.5 * len(rows) + 30 and more.distinct().count() == docs.distinct().count()
    assert mixing.realise(docs.limit(0)).count() == 0
