"""Licence labels and scores against plain Python, which tries every template at every place."""

import math
import random

from rastrel.llm import licenses as L

from . import brute


def _plain(texts):
    words = [brute.WORDS.findall((t or "").translate(brute.LOWER)) for t in texts]
    vocabulary = sorted({w for text, _ in L.PHRASES for w in text.split()} | {w for _, text, _ in L.TEMPLATES for w in text.split()})
    held = [set(w) for w in words]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in h for h in held))) + 1e-3 for w in vocabulary}
    rare = {w for _, text, _ in L.TEMPLATES for w in sorted(set(text.split()), key=lambda w: (-idf[w], w))[: L.RAREST]}
    out = []
    for w in words:
        labels, score = set(), 0.0
        for text, label in L.PHRASES:
            p = text.split()
            if any(w[i : i + len(p)] == p for i in range(len(w))):
                labels.add(label)
                score = 1.0
        for label, text, key in L.TEMPLATES:
            t, k = text.split(), key.split()
            at_key = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for at in range(-len(t), len(w)):
                same = [i for i in range(len(t)) if 0 <= at + i < len(w) and w[at + i] == t[i]]
                enough = len({t[i] for i in same} & rare) >= min(L.MEET, len(set(t) & rare))
                if enough and set(range(at_key, at_key + len(k))) <= set(same):
                    labels.add(label)
                    score = max(score, sum(idf[t[i]] for i in same) / sum(idf[x] for x in t))
        out.append((",".join(sorted(labels)), min(score, 1.0)))
    return out


def test_labels_and_scores_are_those_of_plain_python(spark):
    rng = random.Random(6)
    texts = [None, "", "the of and", "under the MIT license and CC BY-NC"]
    for _ in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            _, text, key = rng.choice(L.TEMPLATES)
            part = rng.choice([text, key, text[: len(text) // 2], text.upper(), text.replace(" the ", " a "), text + " " + key]).split()
            part = [x if rng.random() > 0.03 else "changed" for x in part]
            words += [rng.choice(["software", "license", "use", "word", "of"]) for _ in range(rng.randint(0, 6))] + part
        texts.append(" ".join(words))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    want = _plain(texts)
    assert [got[k][0] for k in range(len(texts))] == [w[0] for w in want]
    assert all(abs(got[k][1] - w[1]) < 1e-9 for k, w in enumerate(want))
