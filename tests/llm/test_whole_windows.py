"""Decontamination of repeated and null ids, and of benchmarks too large to broadcast."""

import pytest
from pyspark.sql import functions as F

from rastrel.llm import decontaminate as D

PASSAGE = " ".join(f"item{k}" for k in range(12))


@pytest.mark.parametrize("key", [7, None])
def test_clean_rows_of_a_shared_id_stay(spark, key):
    rows = [(key, f"Lead in. {PASSAGE} and out.")] * 5 + [(key, "clean words only")] * 20 + [(key, None)] * 3 + [(key, "")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, hit_doc_id int, t1 string")
    bench = spark.createDataFrame([(1, PASSAGE)] * 4, "item_id long, text string")
    for room in (64 << 20, 0):
        kept = D.drop_contaminated(docs, bench, broadcast_bytes=room)
        assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == sorted(t or "" for _, t in rows[5:])
        cut = D.remove_spans(docs, bench, broadcast_bytes=room)
        assert cut.columns == docs.columns and sorted(repr(r["text"]) for r in cut.collect()) == sorted(repr(t) for t in ["Lead in. " + " " * 11 + " and out."] * 5 + [t for _, t in rows[5:]])
        judged = D.contamination(docs, bench, broadcast_bytes=room).collect()
        assert len(judged) == len(rows) and sum(r["n_hit"] for r in judged) == 60 and sum(len(r["items"]) for r in judged) == 5


def test_bitmap_loses_no_hash_and_passes_few(spark):
    table = spark.range(3000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("key"))
    got = {r["id"] for r in D.in_bitmap(rows, table, 20).collect()}
    assert got >= set(range(3000)) and len(got) < 3000 + 57_000 * 0.01
