"""Finding samples, cycles and plans in tables of file names and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metadata import TILE_NAME

# Names of stitched cycles, with or without their number.
STITCHED = r"(?i)\.ome\.tiff?$"
NOT_STITCHED = r"(?i)^area_"
CYCLE_PREFIX = r"^[Cc]([0-9]+)_"
# Settings of a plan record with their last default and least value.
SETTINGS = {"tile_size": (2000, 128), "sample_count": (5, 1), "iterations": (10, 1), "workers": (0, 0)}
PLAN_VERSIONS = {"register": [1], "stitch": [1, 2]}


def cycles_with_tiles(files: DataFrame, pattern: str = TILE_NAME) -> DataFrame:
    """``(sample, folder, n_tiles)`` of folders that hold at least one acquisition tile, of files ``(sample, folder, name)``."""
    return files.where(F.col("name").rlike(pattern)).groupBy("sample", "folder").agg(F.count("*").alias("n_tiles"))


def stitched_files(files: DataFrame) -> DataFrame:
    """``(sample, cycle, path, place)``: stitched files of immediate folders, in the order of cycle, then path without case."""
    hit = files.where(F.col("name").rlike(STITCHED) & ~F.col("name").rlike(NOT_STITCHED) & F.col("name").rlike(CYCLE_PREFIX))
    hit = hit.select("sample", F.regexp_extract("name", CYCLE_PREFIX, 1).cast("long").alias("cycle"), F.concat_ws("/", "sample", "folder", "name").alias("path")).distinct()
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("cycle", F.lower("path"), "path")))


def scan_samples(files: DataFrame, output: str) -> DataFrame:
    """One record for each sample with a stitched cycle: ``(sample, n_cycles, cycles, output_path)``."""
    rows = stitched_files(files).groupBy("sample").agg(F.count("*").alias("n_cycles"), F.sort_array(F.collect_list(F.struct("place", "cycle"))).alias("c"))
    return rows.select("sample", "n_cycles", F.array_join(F.transform("c", lambda x: x["cycle"].cast("string")), ",").alias("cycles"), F.concat(F.lit(output + "/"), "sample", F.lit(".ome.tiff")).alias("output_path"))


def scan_for_stitching(files: DataFrame) -> DataFrame:
    """``(sample, n_cycles, mean_tiles)`` of samples with tiles."""
    return cycles_with_tiles(files).groupBy("sample").agg(F.count("*").alias("n_cycles"), F.round(F.avg("n_tiles"), 6).alias("mean_tiles"))


def sample_records(files: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked ``(sample, cycle)`` its only stitched file, or why there is none."""
    found = stitched_files(files).groupBy("sample", "cycle").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    rows = asked.join(found, ["sample", "cycle"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("sample", "cycle", F.when(n == 1, F.col("first")).alias("path"), F.when(n == 0, "no stitched file").when(n > 1, "more than one stitched file").alias("problem"))


def read_plan(plans: DataFrame, kind: str = "register") -> DataFrame:
    """``(plan, sample, enabled, *SETTINGS)`` of JSON plans ``(plan, body)`` of a known version.

    A setting is the record's, else the plan's default, else the constant; a 0
    counts as not given; the least value holds for all.  Broken JSON and other
    versions have no rows; a record without a name has an empty one.
    """
    fields = ", ".join(f"{name}: long" for name in SETTINGS)
    schema = f"schema_version long, defaults struct<{fields}>, samples array<struct<name: string, enabled: boolean, {fields}>>"
    rows = plans.select("plan", F.from_json("body", schema).alias("b")).where(F.col("b.schema_version").isin(PLAN_VERSIONS[kind]))
    rows = rows.select("plan", "b.defaults", F.explode("b.samples").alias("s"))
    given = lambda c: F.nullif(c, F.lit(0))
    settings = [F.greatest(F.coalesce(given(F.col(f"s.{name}")), given(F.col(f"defaults.{name}")), F.lit(last)), F.lit(least)).cast("long").alias(name) for name, (last, least) in SETTINGS.items()]
    return rows.select("plan", F.coalesce("s.name", F.lit("")).alias("sample"), F.coalesce("s.enabled", F.lit(True)).alias("enabled"), *settings)


def write_plan(samples: DataFrame, version: int = 1) -> DataFrame:
    """``(plan, body)``: the samples ``(plan, sample, enabled, *SETTINGS)`` of each plan as one JSON text, by name."""
    record = F.struct(F.col("sample").alias("name"), "enabled", *SETTINGS)
    return samples.groupBy("plan").agg(F.sort_array(F.collect_list(record)).alias("samples")).select("plan", F.to_json(F.struct(F.lit(version).alias("schema_version"), "samples")).alias("body"))


def read_manifests(files: DataFrame) -> DataFrame:
    """``(path, fingerprint, n_cycles, n_complete)`` of progress manifests ``(path, body)``; a corrupt or missing one has no row."""
    schema = "fingerprint string, cycles map<string, struct<status: string>>"
    rows = files.select("path", F.from_json("body", schema).alias("m")).where("m.fingerprint is not null")
    done = F.filter(F.map_values("m.cycles"), lambda c: c["status"] == "complete")
    return rows.select("path", "m.fingerprint", F.coalesce(F.size(F.map_keys("m.cycles")), F.lit(0)).alias("n_cycles"), F.coalesce(F.size(done), F.lit(0)).alias("n_complete"))


def batch_results(done: DataFrame, failed: DataFrame) -> DataFrame:
    """``(run, n_ok, n_failed, first_error, seconds)``: reports ``(run, sample, seconds)`` and failures ``(run, sample, error, seconds)`` of runs side by side."""
    rows = done.select("run", "sample", F.lit(None).cast("string").alias("error"), "seconds").unionByName(failed.select("run", "sample", "error", "seconds"))
    return rows.groupBy("run").agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count("error").alias("n_failed"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("sample"))).alias("first_error"), F.round(F.sum("seconds"), 6).alias("seconds"))


def registration_marker(channels: DataFrame, wanted: str) -> DataFrame:
    """The channel to register by ``(sample, cycle)``: the wanted name without case, else the first channel, else the wanted name itself."""
    exact = F.upper(F.trim("name")) == wanted.upper()
    best = channels.where(F.col("channel").isNotNull()).groupBy("sample", "cycle").agg(F.min_by("name", F.when(exact, F.col("channel"))).alias("same"), F.min_by("name", "channel").alias("first"))
    return channels.select("sample", "cycle").distinct().join(best, ["sample", "cycle"], "left").select("sample", "cycle", F.coalesce("same", "first", F.lit(wanted)).alias("marker"))


def rewrite_names(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Messages ``(run, id, msg)`` with the display names of ``(run, cycle, display)`` for cycle numbers, as whole words; the longest number first."""
    pairs = names.groupBy("run").agg(F.sort_array(F.collect_list(F.struct((-F.length(F.col("cycle").cast("string"))).alias("k"), F.col("cycle").cast("string").alias("cycle"), "display"))).alias("names"))
    swap = lambda text, p: F.regexp_replace(text, F.concat(F.lit(r"\b(Cycle|cycle) "), p["cycle"], F.lit(r"\b")), F.concat(F.lit("$1 "), p["display"]))
    return messages.join(pairs, "run", "left").select("run", "id", F.when(F.col("names").isNull(), F.col("msg")).otherwise(F.aggregate("names", F.col("msg"), swap)).alias("msg"))


def copy_template(rows: DataFrame, template: DataFrame) -> DataFrame:
    """``(sample, place, file, marker)``: the template's marker for the same file name, else for the same place, else none."""
    by_name = template.groupBy(F.col("file").alias("file")).agg(F.min_by("marker", "place").alias("by_name"))
    by_place = template.groupBy("place").agg(F.min("marker").alias("by_place"))
    return rows.join(by_name, "file", "left").join(by_place, "place", "left").select("sample", "place", "file", F.coalesce("by_name", "by_place").alias("marker"))


def config_state(samples: DataFrame) -> DataFrame:
    """``(sample, state)`` of ``(sample, n_cycles, n_enabled, n_duplicates)``: missing, invalid or valid."""
    state = F.when(F.coalesce("n_cycles", F.lit(0)) == 0, "missing").when((F.col("n_enabled") == 0) | (F.col("n_duplicates") > 0), "invalid").otherwise("valid")
    return samples.select("sample", state.alias("state"))


def merge_problems(rows: DataFrame) -> DataFrame:
    """``(sample, problem)`` of merge rows ``(sample, cycle_text, marker, channels)``: the first rule that a sample breaks.

    Cycle texts must be whole numbers of at least 0, each once in a sample; the
    marker must be given and be one of the row's channels, without case.
    """
    number = F.expr("try_cast(trim(cycle_text) as bigint)")
    held = F.array_contains(F.transform("channels", F.lower), F.lower(F.trim("marker")))
    judged = rows.select("sample", number.alias("cycle"), (F.length(F.trim(F.coalesce("marker", F.lit("")))) == 0).alias("unmarked"), (~F.coalesce(held, F.lit(False))).alias("absent"))
    told = judged.groupBy("sample").agg(F.count_if(F.col("cycle").isNull() | (F.col("cycle") < 0)).alias("bad"), (F.count("cycle") - F.count_distinct("cycle")).alias("twice"), F.count_if("unmarked").alias("unmarked"), F.count_if("absent").alias("absent"))
    return told.select("sample", F.when(F.col("bad") > 0, "cycle is no number").when(F.col("twice") > 0, "cycle comes twice").when(F.col("unmarked") > 0, "no marker").when(F.col("absent") > 0, "marker is no channel").alias("problem"))


def parse_range(text: Column, most: int) -> tuple[Column, Column]:
    """Start and end of ``start:end`` within 0 and ``most``; blank, auto and all give everything; other texts give nulls."""
    clean = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    whole = clean.isin("", "auto", "all")
    part = lambda k, d: F.when(F.trim(F.split_part(clean, F.lit(":"), F.lit(k))) == "", F.lit(d)).otherwise(F.split_part(clean, F.lit(":"), F.lit(k)).try_cast("long"))
    fits = clean.rlike(r"^\s*\d*\s*:\s*\d*\s*$")
    start = F.when(whole, F.lit(0)).when(fits, F.greatest(F.lit(0), F.least(F.lit(most), part(1, 0)))).cast("long")
    end = F.when(whole, F.lit(most)).when(fits, F.greatest(start, F.least(F.lit(most), part(2, most)))).cast("long")
    return start, end


def parse_floats(text: Column) -> Column:
    """The distinct numbers of a comma-separated list, ascending; what is no number is left out."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.sort_array(F.array_distinct(items))


def work_paths(path: Column) -> dict[str, Column]:
    """Where a run keeps its progress, its chunks and its unfinished file, beside the output."""
    stem = F.regexp_replace(path, STITCHED, "")
    return {"progress": F.concat(path, F.lit(".progress.json")), "store": F.concat(stem, F.lit(".chunks")), "draft": F.concat(path, F.lit(".tmp"))}


def latest_resumable(folders: DataFrame) -> DataFrame:
    """The newest unfinished work folder of each output ``(output, folder, changed, finished)``; of equal times the first by name."""
    open_ = folders.where("not finished")
    newest = open_.groupBy("output").agg(F.max("changed").alias("changed"))
    return open_.join(newest, ["output", "changed"]).groupBy("output", "changed").agg(F.min("folder").alias("folder"))


def remaining_cycles(order: DataFrame, complete: DataFrame) -> DataFrame:
    """Cycles ``(sample, cycle)`` still to be written."""
    return order.select("sample", "cycle").exceptAll(complete.select("sample", "cycle"))
