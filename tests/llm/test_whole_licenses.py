"""Texts with several licence notices keep every label."""

from itertools import combinations

from rastrel.llm.licenses import TEMPLATES, license_scan

from ..conftest import DATA


def test_all_notices_of_a_text_are_found(spark):
    small_texts = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    notices = [(label, text) for label, text, _ in TEMPLATES]
    several = [*combinations(notices, 2), tuple(notices), (notices[0], ("", "free software " * 5000), notices[3])]
    texts = ["\n\n".join(t for _, t in some) for some in several]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (docs, docs.union(small_texts.selectExpr("doc_id + 1000", "text"))):
        got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan(df).collect()}
        assert [k for k, some in enumerate(several) if not {label for label, _ in some if label} <= got[k]] == []
