"""Line runs: repeated rows, long runs and random sequences against plain Python."""

import random

from rastrel.llm.line_runs import dedup_lines

from . import brute

SCHEMA = "doc_id long, text string"


def test_repeated_rows_do_not_multiply(spark):
    text = "\n".join(f"line {k} of a text" for k in range(12))
    once = [(1, text), (2, text), (None, "x\n" + text), (3, None)]
    got = [sorted(map(tuple, dedup_lines(spark.createDataFrame(once * n, SCHEMA)).collect()), key=repr) for n in (1, 50)]
    assert got[1] == [r for r in got[0] for _ in range(50)]
    assert [(r[0], r[2], r[3], r[4]) for r in got[0]] == [(1, 12, 1, 12), (2, 12, 1, 12), (3, 0, 0, 0), (None, 0, 0, 0)]


def test_runs_of_random_sequences(spark):
    rng = random.Random(8)
    pool = [[f"w{rng.randint(0, 3)} a{k}" for k in range(n)] for n in (3, 7, 8, 9, 17, 40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(pool)
            begin = rng.randrange(len(part))
            lines += rng.choice([part[begin : begin + rng.randint(1, 40)], part, [f"own {i} {rng.random()}"], ["same"] * rng.randint(1, 12), ["", " "]])
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for words, lines in ((50, 8), (7, 4)):
        got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"], r["longest_run"]) for r in dedup_lines(docs, least_words=words, least_lines=lines).collect()}
        want = brute.cut_lines(rows, words, lines)
        assert [(i, got[i], want[i]) for i in want if got[i] != want[i]] == []
