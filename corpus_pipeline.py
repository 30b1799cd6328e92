"""The corpus pipeline: five stages, each of them one operator of ``rastrel.llm``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.decontaminate import drop_contaminated
from rastrel.llm.mixing import realise
from rastrel.llm.ngram_join import keep_representatives
from rastrel.llm.quality import keep_quality
from rastrel.llm.scratch import Scratch
from rastrel.llm.wavelet import read_tokens, tokenizer_file, write_tokens

#: The pipeline reads every source at least once and none more often than this.
MOST_REPEATS = 1.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules go, and with them null, empty and blank texts; rows are judged one by one, whatever their id."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links reach, the one with the smallest id stays; of rows equal in id and text one; rows without an id all stay."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds a window of a benchmark item go; an empty benchmark drops nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated towards equal weights; no row is lost, and none is multiplied by others of its id; a null source is one of its own."""
    return realise(docs, most_repeats=MOST_REPEATS, budget_share=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in wavelet matrix files, and where each stands in them; null ids come first, repeated ones side by side."""
    return read_tokens(*write_tokens(docs, tokenizer_file(), end_id=1))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]
#: SQL has neither the tokenizer nor the seeded permutations; ``tests/llm`` compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it; an empty table gives an empty table, and other columns are carried, whatever their names."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
