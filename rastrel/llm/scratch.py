"""Tables that cut lineage, in the folder that every executor shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a session without executors of its own names no ``spark.checkpoint.dir``, as in tests.
FALLBACK = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` with its scheme; ``FALLBACK`` if a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = FALLBACK
        spark.sparkContext.setCheckpointDir(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Scratch:
    """A fresh folder under the shared root; its tables are written by Spark's own committer."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/rastrel-{what}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it read back: what follows depends on the files alone."""
        df.write.parquet(f"{self.path}/{name}")
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no such column."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out
