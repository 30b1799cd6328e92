"""Keys that many rows share: no task gets them all, and no step is quadratic in them."""

import time

import pytest
from pyspark.sql import functions as F

from rastrel.llm.bitmaps import mark, spread
from rastrel.llm.decontaminate import contamination, remove_spans
from rastrel.llm.ngram_join import keep_representatives, ngram_jaccard_components
from rastrel.llm.secrets import secret_spans

from ..conftest import DATA


@pytest.fixture()
def as_on_a_cluster(spark):
    """Nothing is broadcast by size, and partitions stay as they are."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest(df):
    """Rows of the largest partition, and the mean over all."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n), sum(n) / 16


def test_equal_rows_come_back_in_several_tasks(spark, as_on_a_cluster):
    equal = spark.range(1_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    for got in (secret_spans(equal), contamination(equal, bench)):
        most, mean = largest(got)
        assert mean * 16 == 1_000_000 and most < 3 * mean
    few = spark.createDataFrame([(1, "x", 2500), (2, "y", 1), (3, "z", 1000)], "id long, v string, copies long")
    assert sorted((r["id"], r["v"], r["count"]) for r in spread(few, "copies", "id").groupBy("id", "v").count().collect()) == [(1, "x", 2500), (2, "y", 1), (3, "z", 1000)]


def test_unlinked_documents_do_not_meet(spark, as_on_a_cluster):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = ngram_jaccard_components(docs)
    assert got.count() == docs.count()
    # Their rows are read as they were written: no exchange stands above that scan.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (fp" not in plan.replace("#", " ") and "isnull(toks" in plan


def test_representatives_through_full_and_empty_bitmaps(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    named = {(r["doc_id"], r["component_id"]) for r in ngram_jaccard_components(docs).collect()}
    want = sorted([i for i, c in named if i is not None and i == c])
    from rastrel.llm import ngram_join

    for bits in (27, 15):
        monkeypatch.setattr(ngram_join, "mark", lambda *a, b=bits: mark(*a, log_bits=b))
        got = [r["doc_id"] for r in keep_representatives(docs).collect()]
        assert sorted(i for i in got if i is not None) == want and got.count(None) == 5


def test_spans_of_a_text_with_many_hits(spark):
    item = "one two three four five six seven eight nine ten"
    text = " -- ".join([item + " alone"] * 100_000)
    docs = spark.createDataFrame([(1, text), (2, f"{item} {item}!"), (3, "clean text"), (4, f"Before, {item.upper()}. After"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in remove_spans(docs, bench).collect()}
    assert time.time() - began < 60
    gone = " " * 9
    assert got[1] == " -- ".join([gone + " alone"] * 100_000)
    assert got[2] == " " * 19 + "!" and got[3] == "clean text" and got[4] == "Before, " + gone + ". After" and got[5] is None
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in contamination(docs, bench).collect()}
    assert spans[2] == [(0, 20)] and spans[4] == [(1, 11)] and spans[3] == [] and len(spans[1]) == 100_000
