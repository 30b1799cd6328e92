"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

DataFrame functions only.  Every training window of ``n`` words is hashed inside
one code-generated scan, probed against the hash set of the benchmark's windows,
and a hit is verified on the words themselves.  The scan shuffles one row for
each document and one for each verified hit, never the windows.  A benchmark too
large for that is first broadcast as a bitmap of its hashes, of a fixed size; the
windows whose bit is set are then joined with it by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import spread
from .scratch import fresh

#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A window's position and length share one number.
STEP = 64
#: Binary logarithm of the bits of the bitmap for large benchmarks: 64 MB, in rows of 4 KB.
BITMAP_LOG = 29
#: A row of documents: its id and 128 bits of its text.  The same whenever a lost task is run again.
KEY = ["doc_id", "t1", "t2"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _keyed(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """``(win, len, items)``: each distinct window with the sorted ids, as strings, of the items that hold it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    items = items.withColumn("len", F.least(F.lit(n), F.size("w")))
    wins = items.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    return wins.select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("win")).groupBy("win", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def in_bitmap(rows: DataFrame, hashes: DataFrame, log_bits: int = BITMAP_LOG) -> DataFrame:
    """The rows whose ``key`` may be among the hashes ``h``: those whose bit is set in a bitmap of ``2 ** log_bits`` bits."""
    place = lambda h: F.pmod(h, F.lit(1 << log_bits))
    bits = hashes.select(F.bitmap_bucket_number(place(F.col("h"))).alias("bucket"), F.bitmap_bit_position(place(F.col("h"))).alias("bit"))
    bits = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))  # at most 2 ** (log_bits - 15) rows of 4 KB
    at = F.bitmap_bit_position(place(F.col("key"))).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(F.col("key"))) == F.col("bucket"))
    return found.where(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1).drop("bucket", "bits")


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str, broadcast_bytes: int) -> DataFrame:
    """``(*KEY, n_words, at, len, items, copies)``: one row of a document with ``at`` null, and one for each hit."""
    if not 0 < n < STEP:
        raise ValueError(f"n must lie in 1..{STEP - 1}")
    wins = benchmark_windows(benchmark, n, item_col, item_text_col)
    # One row: the lengths (at most n of them) and the size that the broadcast would have.
    told = wins.agg(F.collect_set("len").alias("lens"), F.sum(F.length(F.array_join("win", " ")) + 24 * F.size("win") + F.length(F.array_join("items", " ")) + 24 * F.size("items") + 64).alias("bytes")).first()
    lens = sorted(told["lens"]) or [n]
    table = wins.select(F.xxhash64("win").alias("h"), "win", "items")
    none = F.array().cast("array<int>")
    starts = [F.when(F.size("w") >= k, F.sequence(F.lit(k), (F.size("w") - k) * STEP + k, F.lit(STEP))).otherwise(none) for k in lens]
    rows = docs.select(*_keyed(id_col, text_col), F.coalesce(words(F.col(text_col)), F.array().cast("array<string>")).alias("w"))
    rows = rows.select(*KEY, "w", F.explode(F.concat(F.array(F.lit(-1)), *starts)).alias("code"))
    window = F.slice("w", F.expr(f"code div {STEP}").cast("int") + 1, F.greatest(F.col("code") % STEP, F.lit(0)))
    # From here on a row holds its window alone, never the whole text.
    probe = rows.select(*KEY, F.size("w").cast("long").alias("n_words"), "code", F.when(F.col("code") >= 0, window).alias("own")).withColumn("key", F.when(F.col("code") >= 0, F.xxhash64("own")))
    same = (F.col("key") == F.col("h")) & (F.col("own") == F.col("win"))
    if (told["bytes"] or 0) <= broadcast_bytes:
        met = probe.join(F.broadcast(table), same, "left").where("code < 0 or h is not null")
    else:  # rows without a window would all share one null key
        met = in_bitmap(probe.where("code >= 0"), table).join(table, same).unionByName(probe.where("code < 0"), allowMissingColumns=True)
    met = met.select(*KEY, "n_words", F.when(F.col("code") >= 0, F.expr(f"cast(code div {STEP} as long)")).alias("at"), F.when(F.col("code") >= 0, F.col("code") % STEP).alias("len"), "items")
    return met.groupBy(*KEY, "n_words", "at", "len", "items").agg(F.count("*").alias("copies"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)`` for each row of ``docs``.

    A benchmark item's windows are its runs of ``n`` words, ``n`` being 63 at
    most, or the whole item if it has fewer but some; a document word inside any
    occurrence of a window is hit.  ``items``: the ids, as sorted strings, of
    items with an occurring window; ``spans``: the merged hit ranges
    ``(first word, last word + 1)``.  Null or wordless texts have no words and no
    hits; an item without words has no window; repeated items are one; an empty
    benchmark hits nothing; an empty table gives an empty table; equal rows are
    judged once and returned as often as they stand in the table, rows of one id
    (or of none) with different texts one by one; other columns are not read.
    Texts may have any length: a task holds one text's words at a time.  The
    windows are broadcast if they take at most ``broadcast_bytes``, else a bitmap
    of fixed size is, and the few windows that pass it are shuffled.
    """
    done = _judged(_hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col, broadcast_bytes))
    return spread(done, "copies", *KEY).select("doc_id", "n_words", "n_hit", "items", "spans")


def _judged(hits: DataFrame) -> DataFrame:
    """``(*KEY, copies, n_words, n_hit, items, spans)`` of each different row."""
    order = Window.partitionBy(*KEY).orderBy("at", "len")
    before = F.coalesce(F.max(F.col("at") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = hits.withColumn("before", before)
    end = F.col("at") + F.col("len")
    runs = runs.withColumn("fresh", F.coalesce(F.greatest(end - F.greatest("at", "before"), F.lit(0)), F.lit(0)))
    first = F.greatest("at", "before")
    # Windows that touch make one span: a new one begins where a window starts behind all before it.
    opens = (F.col("fresh") > 0) & ((F.col("at") > F.col("before")) | (F.col("at") == 0))
    runs = runs.withColumn("span", F.sum(F.when(opens, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*KEY, "span").agg(
        F.max(F.when(F.col("at").isNull(), F.col("copies"))).alias("copies"), F.max("n_words").alias("n_words"), F.sum("fresh").alias("fresh"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.min(F.when(F.col("fresh") > 0, first)).alias("first"), F.max(end).alias("last"),
    )
    one = F.when(F.col("span") > 0, F.struct("first", "last"))
    # Windows of one passage have the same items: the set has one list of them.
    return spans.groupBy(*KEY).agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sort_array(F.collect_list(one)).alias("spans"))


def _beside(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` joined with what was found in their own text, whatever names their columns have."""
    names = fresh(docs, *(f"hit_{k}" for k in KEY))
    keys = _keyed(id_col, text_col)
    same = [keys[0].eqNullSafe(F.col(names[0])), keys[1] == F.col(names[1]), keys[2] == F.col(names[2])]
    for k, name in zip(KEY, names):
        found = found.withColumnRenamed(k, name)
    joined = docs.join(found, same[0] & same[1] & same[2], how)
    return joined.drop(*names) if how != "left_anti" else joined


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark window; all columns stay.

    Null and empty texts stay; each row of a repeated or null id is judged by its
    own text; an empty table or benchmark drops nothing.
    """
    hits = _hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col, broadcast_bytes)
    return _beside(docs, hits.where("at is not null").select(*KEY).distinct(), id_col, text_col, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with the words of hit spans cut out of ``text_col``; what separates words stays.

    Clean texts are returned unchanged, null ones as null; rows of a repeated or
    null id are cut one by one; an empty table gives an empty table.
    """
    (cut_at,) = fresh(docs, "spans")
    found = _judged(_hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col, broadcast_bytes)).where("n_hit > 0").select(*KEY, F.col("spans").alias(cut_at))
    joined = _beside(docs, found, id_col, text_col, "left")
    (got_words,) = fresh(joined, "got_words")
    joined = joined.withColumn(got_words, F.regexp_extract_all(F.col(text_col), F.lit(WORD_ANY_CASE), F.lit(0)))
    gaps = F.split(F.col(text_col), WORD_ANY_CASE, -1)
    # Words between spans stay, those of a span become empty: one pass over either list.
    spans = F.transform(cut_at, lambda s: F.struct(s["first"].cast("int").alias("first"), s["last"].cast("int").alias("last")))
    after = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"]))
    before = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(got_words)))
    stays = F.zip_with(after, before, lambda a, b: F.slice(got_words, a + 1, b - a))
    goes = F.concat(F.transform(spans, lambda s: F.array_repeat(F.lit(""), s["last"] - s["first"])), F.array(F.array().cast("array<string>")))
    kept = F.flatten(F.zip_with(stays, goes, lambda a, b: F.concat(a, b)))
    cut = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), kept, lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1))
    return joined.withColumn(text_col, F.when(F.col(cut_at).isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)
