"""Repeated rows and rows without an id in mixing."""

import pytest

from rastrel.llm import mixing


@pytest.mark.parametrize("key", [7, None])
def test_repeated_rows_are_not_multiplied_by_mixing(spark, key):
    docs = spark.createDataFrame([(key, "a b c", s) for s in ["big"] * 8] + [(k, "w " * 5, "big") for k in range(100, 400)] + [(k, "w " * 5, None) for k in range(40)], "doc_id long, text string, source string")
    got = mixing.realise(docs, most_repeats=1.5, budget_share=None)
    assert got.columns == docs.columns
    counted = got.where("text = 'a b c'").count()
    assert 8 <= counted <= 16 and got.count() <= 1.5 * docs.count()
