"""Tables that cut the lineage of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no ``spark.checkpoint.dir``, as in tests.
FALLBACK = "file:///tmp/checkpoints"


class Steps:
    """Numbered states of one loop; the state before the last is deleted unless ``keep_all``."""

    def __init__(self, spark: SparkSession, what: str, keep_all: bool = False):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = FALLBACK
            spark.sparkContext.setCheckpointDir(root)
        self.keep_all = keep_all
        self.spark, self.path, self.k = spark, f"{root.rstrip('/')}/rastrel-{what}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.k += 1
        df.write.parquet(f"{self.path}/{self.k}")
        if self.k > 1 and not self.keep_all:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.k - 1}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.k}")
