"""Each stage and the pipeline on odd, empty and clashing tables."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, hit_doc_id int, kept_id string, mix_id int"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(14)))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def _text(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def _odd():
    texts = [(None, _text("null")), (None, _text("null")), (None, None), (1, _text("a")), (1, _text("a")), (1, _text("b")), (2, _text("a") + " tail"), (3, ""), (4, " \n"), (5, "same words " * 50)]
    texts += [(6, _text("item", 14) + " " + _text("lead")), (None, _text("item", 14) + " " + _text("end")), (None, _text("clean"))] + [(7, _text("c"))] * 50 + [(None, _text("d"))] * 20 + [(8, _text("long", 30_000))]
    return [(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, 0, 0, "", 0) for k, (i, t) in enumerate(texts)]


def test_stages_on_odd_rows(spark, stages, folder):
    docs = spark.createDataFrame(_odd(), SCHEMA)
    names = docs.columns
    counts = [docs.count()]
    for name, stage in stages:
        docs = stage(spark, docs, folder)
        if name != "tokens":
            assert docs.columns == names
            docs = spark.createDataFrame(docs.collect(), SCHEMA)
        counts.append(docs.count())
    # quality: four rows go; copies of rows: 1 and 49, and document 2; contaminated: two
    assert counts[1] == counts[0] - 4 and counts[2] == counts[1] - 51 and counts[3] == counts[2] - 2
    assert counts[3] <= counts[4] <= 1.5 * counts[3] + 20 and counts[5] == counts[4]


def test_stages_on_empty_tables(spark, stages, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in stages:
        assert stage(spark, docs, folder).count() == 0


def test_the_pipeline_takes_an_odd_table(spark, stages, folder, tmp_path):
    import corpus_pipeline

    for k, rows in enumerate((_odd(), [])):
        root = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
        got = corpus_pipeline.run(spark, root)
        starts = sorted((r["start"], r["n_tokens"]) for r in got.collect())
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and bool(starts) == bool(rows)
