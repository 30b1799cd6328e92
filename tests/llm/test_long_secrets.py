"""Secrets in very long candidates, and in equal rows; entropy spans against plain Python."""

import math
import random
import re

from rastrel.llm import secrets
from rastrel.llm.secrets import secret_spans

from . import brute

rng = random.Random(2)
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _entropy(w):
    return -sum(c / len(w) * math.log2(c / len(w)) for c in (w.count(x) for x in set(w)))


def _entropy_spans(text):
    """Candidates' spans by rescanning every window, without an allow-list."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        is_hex = re.fullmatch("[0-9a-fA-F]+", m[0]) is not None
        s, bits = (m[0].lower(), secrets.HEX_BITS) if is_hex else (m[0], secrets.B64_BITS)
        high = [i for i in range(len(s) - 19) if _entropy(s[i : i + 20]) >= bits - 1e-9]
        if high:
            out.append((m.start() + high[0], 3 if is_hex else 4, m.start() + high[-1] + 20))
    return out


def test_entropy_spans_are_those_of_all_windows(spark):
    texts = []
    for k in range(80):
        parts = ["".join(rng.choice(BASE64[: rng.choice([3, 6, 12, 64])] if rng.random() < 0.7 else "0123456789abcdef") for _ in range(rng.choice([19, 20, 21, 40, 255, 275, 276, 600]))) for _ in range(3)]
        texts.append("ü " + " ".join(parts) + " aaaa" * (k % 3))
    got = {r["doc_id"]: [(s["first"], s["rank"], s["last"]) for s in r["spans"] if s["rank"] > 2] for r in secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), allow=[]).collect()}
    assert got == {k: sorted(_entropy_spans(t)) for k, t in enumerate(texts)}


def test_candidates_of_a_megabyte(spark):
    run = "".join(rng.choice(BASE64) for _ in range(1 << 20))
    texts = [
        "k a" + "-b1" * 350_000 + " end", "x " + run + " y", "/path" * 20_000, "0123456789" * 10_000, "a" * 100_000 + "1", "550e8400-" * 10_000, "a1" * 50_000,
        "password = " + "A1b2" * 20_000, "token" + " " * 100_000 + "=", "AKIA" + "Q7" * 20_000, "0" * 100_000, "x " + "Zz9-" * 20_000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_spans(docs).collect()}
    assert {k: [(a, r, n, b) for a, r, n, b in s if r < 3] for k, s in got.items()} == {k: brute.base_secrets(t) for k, t in enumerate(texts)}
    assert {k: [(a, n, b) for a, r, n, b in s if r > 2] for k, s in got.items() if any(r > 2 for _, r, _, _ in s)} == {1: [(2, "entropy_b64", 2 + (1 << 20))]}


def test_equal_rows_are_each_returned(spark):
    one = 'secret="abcdef99" and ' + "0123456789abcdef" * 3
    rows = [(None, one)] * 7 + [(4, one)] * 50 + [(4, None)] * 3 + [(4, "")] * 2
    got = [(r["doc_id"], len(r["spans"])) for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, 2)] * 7 + [(4, 2)] * 50 + [(4, 0)] * 5, key=repr)
