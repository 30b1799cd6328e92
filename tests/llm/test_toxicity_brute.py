"""Toxicity scores against plain Python, and a fit that repeated ids do not enlarge."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from rastrel.llm import textops as T
from rastrel.llm import toxicity as X

LABELLED = "doc_id long, toxic int"


def _hash(raw):
    """The hash of one byte string, by its definition: a polynomial over random values of bytes, then mixed."""
    p = int(T._P)
    h = sum(int(T._BYTE[b]) * pow(p, k, 2**64) for k, b in enumerate(raw)) + len(raw) * p
    return int(T.mix(np.array([h % 2**64], np.uint64))[0])


def _slots(text):
    """The hashed n-grams of a text, one by one: so many characters, not bytes."""
    text = text.lower()
    return {_hash(text[i : i + n].encode()) % X.SLOTS for n in X.LENGTHS for i in range(len(text) - n + 1)}


def _table(seed=4):
    rng = random.Random(seed)
    words, bad = [f"word{k}" for k in range(60)] + ["Été", "漢字かな交じり", "🙂🙂"], ["vile", "scum", "LOATHE", "Ärgernis", "馬鹿野郎め"]
    out = []
    for k in range(240):
        y = rng.random() < 0.4
        out.append((k, " ".join(rng.choice(bad if y and rng.random() < 0.3 else words) for _ in range(rng.randint(5, 30))), int(y)))
    return out


def test_scores_are_those_of_plain_python(spark):
    table = _table()
    docs, labels = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in table], LABELLED)
    got = {r["doc_id"]: r["score"] for r in X.toxicity_scores(docs, labels, most_features=300).collect()}
    seen = [(k, _slots(t), y) for k, t, y in table if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [sum(y == c for _, _, y in seen) for c in (0, 1)]
    counts = {}
    for _, slots, y in seen:
        for s in slots:
            counts.setdefault(s, [0, 0])[y] += 1
    ratio = {s: math.log((c[1] + 1) / (rows[1] + 2) / ((c[0] + 1) / (rows[0] + 2))) for s, c in counts.items()}
    telling = {s: abs(ratio[s]) / math.sqrt(1 / (c[1] + 1) + 1 / (c[0] + 1)) for s, c in counts.items() if sum(c) >= 3}
    keep = set(sorted((s for s in telling if telling[s] > 0), key=lambda s: (-telling[s], s))[:300])
    full = np.zeros(X.SLOTS)
    for s, r in ratio.items():
        full[s] = r
    weights, bias = X.fit_weights(np.array([y for _, _, y in seen]), [np.array(sorted(slots & keep), np.int32) for _, slots, _ in seen], full)
    for k, text, _ in table:
        z = sum(weights[s] for s in _slots(text)) + bias
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-6


def test_repeated_rows_leave_the_fit_as_it_is(spark):
    table = _table()
    docs, labels = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in table], LABELLED)
    many = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(200)).select("doc_id", "text")).union(spark.createDataFrame([(None, "vile")] * 20, docs.schema))
    one, two = X.train(docs, labels, most_rows=90), X.train(many, labels.union(labels.limit(40)), most_rows=90)
    assert np.allclose(one[0], two[0]) and abs(one[1] - two[1]) < 1e-9


def test_features_are_those_of_each_text_alone():
    texts = [None, "", "ab", "Ünder ÉCOLE", "漢字かな交じり文の例", "🙂🙂🙂🙂🙂 mixed ÀÉ 漢字", "aaaaaaaaaa", "x" * 700]
    keep = np.zeros(X.SLOTS, bool)
    keep[::3] = True
    for marked in (None, keep):
        got = [set(f.tolist()) for _, _, raw, at in T.blocks(X.lowered(pa.array(texts)), 64) for f in X.features(raw, at, marked)]
        assert got == [{s for s in _slots(t or "") if marked is None or marked[s]} for t in texts]
