"""File names, channel layouts and plans as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The usual name of an acquisition tile, and of a cycle's folder.
TILE_NAME = r"(?i)^(?:area|raw)_.*_(\d+)_(\d+)\.ome\.tiff?$"
CYCLE_NAME = r"^[Cc](\d+)_(.*)$"


def parse_tiles(files: DataFrame, pattern: str = TILE_NAME, x_group: int = 1, y_group: int = 2) -> DataFrame:
    """``(path, gx, gy)`` of the files whose names fit."""
    hit = files.where(F.col("path").rlike(pattern))
    return hit.select("path", F.regexp_extract("path", pattern, x_group).cast("long").alias("gx"), F.regexp_extract("path", pattern, y_group).cast("long").alias("gy"))


def parse_cycles(folders: DataFrame) -> DataFrame:
    """``(folder, number, rest, suffix, cycle)``: a letter where a number comes twice, and a dense index.

    The dense index counts folders before it; it is found from counts by number,
    so that only numbers are put in one order, not folders.
    """
    from ..functions.scalars import letter_suffix

    hit = folders.where(F.col("folder").rlike(CYCLE_NAME)).select("folder", F.regexp_extract("folder", CYCLE_NAME, 1).cast("long").alias("number"), F.regexp_extract("folder", CYCLE_NAME, 2).alias("rest"))
    counts = hit.groupBy("number").agg(F.count("*").alias("n"))
    before = counts.select("number", "n", F.coalesce(F.sum("n").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("number").orderBy("folder")) - 1
    return hit.join(before, "number").withColumn("place", place).select("folder", "number", "rest", F.when(F.col("n") > 1, letter_suffix(F.col("place"))).otherwise(F.lit("")).alias("suffix"), (F.col("before") + F.col("place")).cast("long").alias("cycle"))


def channel_layout(channels: DataFrame) -> DataFrame:
    """Offsets and names of merged channels ``(sample, cycle, label, channel, name)``.

    Cycles follow each other in ascending order; a name is ``<name>_cy<label>``,
    and later ones of the same name get ``_2``, ``_3``, ...
    """
    size = channels.groupBy("sample", "cycle").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sample").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    offsets = size.select("sample", "cycle", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))
    stem = F.concat(F.when(F.length(F.trim("name")) > 0, F.trim("name")).otherwise(F.lit("Channel")), F.lit("_cy"), F.coalesce("label", F.col("cycle").cast("string")))
    placed = channels.join(offsets, ["sample", "cycle"]).withColumn("out", F.col("offset") + F.col("channel")).withColumn("stem", stem)
    k = F.row_number().over(Window.partitionBy("sample", "stem").orderBy("out"))
    return placed.select("sample", "cycle", "channel", "out", F.when(k > 1, F.concat("stem", F.lit("_"), k.cast("string"))).otherwise(F.col("stem")).alias("out_name"))


def write_order(cycles: DataFrame, reference: int) -> DataFrame:
    """The reference cycle first, the others in ascending order."""
    w = Window.partitionBy("sample").orderBy((F.col("cycle") != reference).cast("int"), "cycle")
    return cycles.select("sample", "cycle", F.row_number().over(w).alias("ord"))


def fingerprint(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """One hash over a key's rows, whatever their order: equal if and only if the rows are.

    A row is its fields as JSON, in the order given, so that no text can stand
    for two fields and no name for a missing one.
    """
    item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


def completed_prefix(progress: DataFrame) -> DataFrame:
    """Cycles that are complete with all before them, in write order ``(sample, ord, cycle, status)``."""
    upto = Window.partitionBy("sample").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.min((F.col("status") == "complete").cast("int")).over(upto)
    return progress.withColumn("ok", ok).where("ok = 1").select("sample", "ord", "cycle")


def first_incomplete(progress: DataFrame) -> DataFrame:
    return progress.where(F.coalesce(F.col("status"), F.lit("")) != "complete").groupBy("sample").agg(F.min_by("cycle", "ord").alias("cycle"), F.min("ord").alias("ord"))


def explode_plan(plan: DataFrame) -> DataFrame:
    """Cycle rows of samples with parallel arrays; a missing flag counts as enabled, a missing name as empty."""
    row = F.posexplode("cycles").alias("place", "cycle")
    flat = plan.select("sample", "files", "markers", "enabled", row)
    return flat.select("sample", "place", "cycle", F.get("files", F.col("place")).alias("file"), F.coalesce(F.get("markers", F.col("place")), F.lit("")).alias("marker"), F.coalesce(F.get("enabled", F.col("place")), F.lit(True)).alias("enabled")).where("enabled").drop("enabled")


def duplicate_cycles(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample", "cycle").agg(F.count("*").alias("n")).where("n > 1").select("sample", "cycle", "n")


def readiness(samples: DataFrame) -> DataFrame:
    """The first rule that a sample ``(sample, output, n_cycles, n_duplicates, n_unmarked)`` breaks, null if none."""
    rules = [
        (F.length(F.trim(F.coalesce("output", F.lit("")))) == 0, "no output path"),
        (F.col("n_cycles") == 0, "no enabled cycles"),
        (F.col("n_duplicates") > 0, "duplicate cycle numbers"),
        (F.col("n_unmarked") > 0, "no registration marker"),
    ]
    return samples.select("sample", F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in rules]).alias("problem"))


def latest_events(events: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The newest event of each key; maxima combine before any shuffle."""
    keep = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(at, tie)).alias("e")).select(*key, "e.*")


def sample_by_class(rows: DataFrame, label: str, cap: int, *order: str) -> DataFrame:
    """At most ``cap`` rows of each class, by a hash that needs no random state.

    Each hash range keeps its own first rows before the class is ranked, so no
    task holds a whole class.
    """
    h = F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in order]))
    keyed = rows.withColumn("_h", h)
    near = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(label, F.substring("_h", 32, 1)).orderBy("_h"))).where(F.col("_k") <= cap)
    return near.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("_h"))).where(F.col("_k") <= cap).drop("_k", "_h")


def ome_channels(docs: DataFrame) -> DataFrame:
    """Channel names of OME-XML texts ``(image, xml)``; blank names become ``Channel i``."""
    got = F.xpath("xml", F.lit("//*[local-name()='Channel']/@Name"))
    return docs.select("image", F.posexplode(got).alias("channel", "name")).select("image", "channel", F.when(F.length(F.trim("name")) > 0, F.trim("name")).otherwise(F.concat(F.lit("Channel "), F.col("channel").cast("string"))).alias("name"))


def sweep(spark, spacings: list[int], iterations: list[int], weights: list[float], limits: list[int]) -> DataFrame:
    """All combinations of four short lists of settings."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, spacings))).alias("spacing"))
    for name, values in (("iterations", iterations), ("weight", weights), ("limit", limits)):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return one


def tile_class(gain, corr, shift, accepted):
    """One of five kinds of a registration tile, by the first rule that fits."""
    return F.when(accepted & (gain >= 0.05), "improved").when(accepted, "accepted").when(corr >= 0.85, "already good").when(shift == 0, "no shift").otherwise("rejected")
