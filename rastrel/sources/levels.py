"""Pyramids as folders of Parquet, one for each level, built from the one before and taken up again where they were left; tables for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import block_mean

#: The mark that Spark's committer leaves in a folder when all its files are there.
DONE = "_SUCCESS"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_done(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, f"{path}/{DONE}")
    return bool(fs.exists(p))


def _content(px: DataFrame, columns: list[str]) -> str:
    """A text that differs if the rows do, whatever their order or partitions: their number and two sums of hashes."""
    row = [F.col(c) for c in columns]
    sums = [F.sum(F.xxhash64(*extra, *row).cast("decimal(38, 0)")) for extra in ([], [F.lit(1)])]
    return " ".join(str(v) for v in px.agg(F.count("*"), *sums).first())


def _stored(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    return "\n".join(r["value"] for r in spark.read.text(path).collect()) if fs.exists(p) else None


def write_levels(px: DataFrame, path: str, levels: int, by: tuple[str, ...] = ("channel",)) -> list[bool]:
    """Write levels 0 to ``levels`` of pixels ``(*by, y, x, v)`` to ``path/level=k``; which of them were built now.

    A level counts as there only with its mark, whatever files it has: an
    interrupted one has none.  From the first missing level on all are deleted and
    built anew, so none is ever made from an older run's.  The pixels' fingerprint
    is kept in ``path/content``: if it is another one, or none, all levels go before
    it is written, so that an interruption leaves no old level under a new one.
    """
    spark, built = px.sparkSession, []

    def drop(name: str) -> None:
        fs, p = _path(spark, f"{path}/{name}")
        fs.delete(p, True)

    content = _content(px, [*by, "y", "x", "v"])
    if _stored(spark, f"{path}/content") != content:
        fs, folder = _path(spark, path)
        for name in [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []:
            if name.startswith("level=") or name == "content":
                drop(name)
        out = fs.create(_path(spark, f"{path}/content")[1], True)
        out.write(bytearray(content.encode()))
        out.close()
    for k in range(levels + 1):
        target = f"{path}/level={k}"
        make = any(built) or not is_done(spark, target)
        if make:
            for later in range(k, levels + 1):
                drop(f"level={later}")
            level = px if k == 0 else block_mean(spark.read.parquet(f"{path}/level={k - 1}"), by=by)
            level.select(*by, "y", "x", "v").write.parquet(target)
        built.append(make)
    return built


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """One level; a level without its mark is an error, not an empty plane."""
    if not is_done(spark, f"{path}/level={level}"):
        raise FileNotFoundError(f"{path} has no finished level {level}")
    return spark.read.parquet(f"{path}/level={level}")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header; nested columns become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
