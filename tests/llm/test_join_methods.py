"""Class borders come from the frequencies, and pairs at the border are decided on their words."""

import numpy as np

from rastrel.llm import ngram_join as J
from rastrel.llm.scratch import Scratch

from ..conftest import DATA

def test_borders_follow_the_frequencies():
    counts = np.zeros(512, np.int64)
    counts[8], counts[24], counts[40] = 9700, 250, 50  # frequencies 2, 8 and 32
    low, high = J.class_borders(counts, (0.03, 0.01))
    assert 2 <= low < 8 <= high < 32
    assert J.class_borders(np.bincount([16 * 8] * 9, minlength=512)) == [4096, 65536]
    assert J.class_borders(np.zeros(512, np.int64)) == [2, 3]


def test_the_registered_query_combines_tokens(spark):
    report = {}
    J.ngram_jaccard_components(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), report=report)
    assert all(report["signatures"].get(k, 0) > 0 for k in (1, 2, 3)), report


def test_texts_decide_at_the_border(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    texts = {1: base, 2: base[:90], 3: base[:79], 4: base[:78], 5: ["X1", *base[1:60], *(f"v{k}" for k in range(60))]}  # 86, 75 and 74 of 100
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    assert all(J._verdict(both, 175, 3, 4) == (both >= 75, False) for both in (74, 75))
    docs = spark.createDataFrame([r for r in rows if r[0] in (1, 3, 5)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.ngram_jaccard_components(docs).collect()} == {1: 1, 3: 1, 5: 5}
    docs = spark.createDataFrame([r for r in rows if r[0] in (1, 4)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.ngram_jaccard_components(docs).collect()} == {1: 1, 4: 4}
    # 48 bits alone would take or leave these pairs; the words do not
    pairs = spark.createDataFrame([(1, 4, False), (1, 3, False), (1, 2, True)], "a long, b long, sure boolean")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    import pyarrow as pa
    import xxhash

    (_, sets), = J.shingle_sets([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])], 5)
    rep = spark.createDataFrame([(xxhash.xxh3_128_digest(s.tobytes()), i, i) for s, (i, _) in zip(sets, rows)], "fp binary, rep long, class long")
    assert sorted(map(tuple, J._settled(pairs, table, rep, 5, 3, 4, Scratch(spark, "settled-test"), "x").collect())) == [(1, 2), (1, 3)]
