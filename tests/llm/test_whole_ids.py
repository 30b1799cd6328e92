"""Ids that stand for several texts."""

from rastrel.llm.ngram_join import ngram_jaccard_components


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, "quite another text of its own")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_jaccard_components(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
