"""Line dedup: maximal repeated runs of lines by a suffix array over line-ID sequences.

Every non-blank line of a document is a symbol; the lines of all documents, one
document after the other, are the text, and a line's place in it is one number.
Distributed prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines,
lines being ordered by their hash and longer prefixes by the pair of ranks that
stand at them and half a length further on.  A suffix that no other shares is
settled and leaves; doubling ends when all have left.  Suffixes of equal rank are
an interval of the suffix array whose longest common prefix has at least that
many lines.  Between two powers of two the intervals are bisected: an interval of
length L splits by the rank of the prefix that ends d lines beyond it, until each
suffix has the longest prefix that stands at an earlier place too.  Those that no
longer one of the same document contains are the maximal repeated runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: A repeated run is cut if it has this many words, or this many lines.
LEAST_WORDS, LEAST_LINES = 50, 8


#: A line with a word.
FULL = r"[^\x20\x09-\x0D]"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, doc, row, lines, full)``: ``doc`` orders documents, ``row`` tells texts of one id apart; ``full`` has 128 bits and the words of each non-blank line."""
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(key, text).alias("row"), F.split(text, "\n", -1).alias("lines"))
    line = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.regexp_count(x, F.lit(FULL + "+")).alias("words"))
    return split.withColumn("full", F.transform(F.filter("lines", lambda x: x.rlike(FULL)), line))


def _lines(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``(pos, start, doc, row, h1, h2, until)``: lines in order, of one document for each different sequence.

    ``pos`` grows by one from line to line of a document, ``start`` is its first;
    ``until`` counts the document's words up to the line's end.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _documents(docs, id_col, text_col).where("size(full) > 0").select("doc", "row", "full")
    rows = rows.groupBy(F.xxhash64("full").alias("f1"), F.xxhash64(F.lit(1), "full").alias("f2")).agg(F.min(F.struct("doc", "row", "full")).alias("d")).select("d.*")
    rows = scratch.save(rows, "documents")
    rows = rows.repartitionByRange(parts, "doc", "row").sortWithinPartitions("doc", "row").select("doc", "row", F.posexplode("full").alias("at", "line"))
    until = F.sum("line.words").over(Window.partitionBy("doc", "row").orderBy("at"))
    rows = rows.select("doc", "row", "at", "line.h1", "line.h2", until.alias("until")).withColumn("pos", F.monotonically_increasing_id())
    return scratch.save(rows.select("pos", (F.col("pos") - F.col("at")).alias("start"), "doc", "row", "h1", "h2", "until"), "lines")


def _ranked(groups: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Keys that occur twice or more, ``(r1, r2, n, first)``, each with a rank that follows their order."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = groups.where("n > 1").repartitionByRange(parts, "r1", "r2").sortWithinPartitions("r1", "r2")
    return scratch.save(ordered.select("r1", "r2", "first").withColumn("rank", F.monotonically_increasing_id()), name)


def _classes(keyed: DataFrame, scratch: Scratch, level: int) -> DataFrame:
    """``(pos, start, until, rank, first)`` of the places of ``keyed`` whose key ``(r1, r2)`` occurs again; ``first``: where it does so first."""
    ranks = _ranked(keyed.groupBy("r1", "r2").agg(F.count("*").alias("n"), F.min("pos").alias("first")), scratch, f"ranks-{level}")
    return scratch.save(keyed.join(ranks, ["r1", "r2"]).select("pos", "start", "until", "rank", "first"), f"level-{level}")


def suffix_levels(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each power of two, the suffixes that share their first so many lines with another."""
    levels = [_classes(lines.select("pos", "start", "until", F.col("h1").alias("r1"), F.col("h2").alias("r2")), scratch, 0)]
    while not levels[-1].isEmpty():
        size = 1 << (len(levels) - 1)
        beyond = F.max("rank").over(Window.partitionBy("start").orderBy("pos").rangeBetween(size, size))
        pairs = levels[-1].select("pos", "start", "until", F.col("rank").alias("r1"), beyond.alias("r2")).where("r2 is not null")
        levels.append(_classes(scratch.save(pairs, f"pairs-{len(levels)}"), scratch, len(levels)))
        scratch.drop(f"pairs-{len(levels) - 1}", f"ranks-{len(levels) - 1}")
    return levels[:-1]


def longest_earlier(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``(pos, start, until, size)``: the most lines from ``pos`` on that stand at an earlier place too, where there are any.

    A row of the search stands for a suffix in an interval of suffixes with
    ``size`` lines in common, known by its first place, ``cls``.  A suffix that is
    not the first of a narrower interval moves into it, followed by that first one
    as a witness (``own`` false); all others stay.  So each interval keeps its
    earliest suffix, and no suffix is in more than one interval for itself.
    """
    later = F.col("pos") > F.col("first")
    moved = [level.where(later).select("pos") for level in levels[1:]]
    ends = [level.join(up, "pos", "left_anti") for level, up in zip(levels, moved)] + levels[-1:]
    found = [ends[0].where(later).select("pos", "start", "until", F.lit(1).cast("long").alias("size"))] if levels else []
    if len(levels) < 2:
        return found[0] if found else None
    state = [e.select("pos", "start", "until", F.lit(k).alias("level"), F.col("first").alias("cls"), F.lit(1 << k).cast("long").alias("size"), later.alias("own")) for k, e in enumerate(ends) if k]
    state = scratch.save(reduce(DataFrame.unionByName, state), "search-0")
    ranks = reduce(DataFrame.unionByName, [level.select(F.lit(k).alias("level"), F.col("pos").alias("near"), "rank") for k, level in enumerate(levels) if k])
    for turn in range(1, len(levels)):
        step = F.expr(f"shiftleft(1L, level - {turn})")
        near = F.col("pos") + F.col("size") + step - F.expr("shiftleft(1L, level)")
        looked = state.where(F.col("level") >= turn).withColumn("near", near).join(ranks.where(F.col("level") >= turn), ["level", "near"], "left").drop("near")
        looked = scratch.save(looked, f"looked-{turn}")
        key = ["level", "cls", "size", "rank"]
        groups = looked.where("rank is not null").groupBy(*key).agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1").drop("n")
        split = looked.join(groups, key, "left")
        narrow = F.when(F.col("first").isNull(), F.array(F.lit(0))).when(later, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2)))
        split = split.select("*", F.explode(narrow).alias("to"), step.alias("step"))
        state = scratch.save(split.select("pos", "start", "until", "level", F.when(F.col("to") == 0, F.col("cls")).otherwise(F.col("first")).alias("cls"), (F.col("size") + F.when(F.col("to") == 0, F.lit(0)).otherwise(F.col("step"))).alias("size"), (F.col("own") & (F.col("to") < 2)).alias("own")), f"search-{turn}")
        scratch.drop(f"looked-{turn}")
        found.append(state.where((F.col("level") == turn) & F.col("own")).select("pos", "start", "until", "size"))
    return reduce(DataFrame.unionByName, found)


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, least_words: int, least_lines: int, scratch: Scratch) -> DataFrame:
    """``(doc, row, n_runs, longest_run, pieces)`` of one document for each different sequence of lines; nulls if nothing repeats."""
    lines = _lines(docs, id_col, text_col, scratch)
    levels = suffix_levels(lines, scratch)
    reps = lines.where("pos = start").select("doc", "row", "start")
    found = longest_earlier(levels, scratch)
    if found is None:
        return reps.select("doc", "row", F.lit(None).cast("long").alias("n_runs"), F.lit(None).cast("long").alias("longest_run"), F.lit(None).cast("array<struct<begin:long,last:long>>").alias("pieces"))
    end = F.col("pos") + F.col("size")
    before = F.max(end).over(Window.partitionBy("start").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("before", F.coalesce(before, F.lit(-1))).where(end > F.col("before"))
    # The words of a run: those up to its last line, less those up to the line before its first.
    last = levels[0].select(F.col("pos").alias("last"), F.col("until").alias("last_until"))
    own = lines.select(F.col("pos").alias("line"), F.col("until").alias("before_until"))
    runs = runs.withColumn("last", end - 1).join(last, "last").join(own, F.col("line") == F.col("pos") - 1, "left")
    words = F.col("last_until") - F.when(F.col("pos") > F.col("start"), F.col("before_until")).otherwise(F.lit(0))
    runs = runs.where((F.col("size") >= least_lines) | (words >= least_words))
    # Pieces do not overlap: what an earlier run cuts is not cut again.
    done = F.coalesce(F.max(F.col("last") + 1).over(Window.partitionBy("start").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = runs.withColumn("done", done)
    piece = F.struct((F.greatest("pos", "done") - F.col("start")).alias("begin"), (F.col("last") - F.col("start")).alias("last"))
    cut = runs.groupBy("start").agg(F.count("*").alias("n_runs"), F.max("size").alias("longest_run"), F.collect_list(piece).alias("pieces"))
    return reps.join(cut, "start", "left").drop("start")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_lines: int = LEAST_LINES, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_runs, longest_run, text)`` for each row of ``docs``.

    A run is a maximal sequence of non-blank lines that stands earlier too, in an
    earlier document or line (by id, then line; texts of one id in the order of a
    hash).  It is cut if it has at least ``least_words`` words or ``least_lines``
    lines; blank lines stay.  Lines are equal if 128 bits of their hashes are.
    ``n_runs`` and ``longest_run`` are of the runs that are cut; they may overlap.
    Null and empty texts have one blank line and give an empty text; an empty
    table gives an empty table; rows that repeat an id and its text are one
    document, each returned with the same lines; a document whose non-blank lines
    are all those of an earlier one is one run, and is compared no further; rows
    without an id come first; texts may have any number of lines, their rows are
    spread over tasks; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-runs")
    cut = scratch.save(repeated_runs(docs, id_col, text_col, least_words, least_lines, scratch).withColumn("known", F.lit(True)), "cuts")
    whole = _documents(docs, id_col, text_col).join(cut, ["doc", "row"], "left")
    n = F.size("full").cast("long")
    # A document that is not the first of its sequence repeats it as a whole.
    copy = F.col("known").isNull() & (n > 0) & ((n >= least_lines) | (F.aggregate("full", F.lit(0).cast("long"), lambda a, x: a + x["words"]) >= least_words))
    whole = whole.withColumn("copy", copy)
    gone = F.when(F.col("copy"), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.flatten(F.transform("pieces", lambda p: F.sequence(p["begin"], p["last"]))))
    place = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(FULL), i)), lambda i: i.isNotNull())
    whole = whole.withColumn("gone", gone).withColumn("place", F.when(F.col("gone").isNotNull(), place))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(every, F.transform("gone", lambda k: F.get("place", k.cast("int")))), lambda i: F.get("lines", i))
    count = lambda c: F.when(F.col("copy"), c).otherwise(F.lit(0)).cast("long")
    return whole.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_runs", count(F.lit(1))).alias("n_runs"), F.coalesce("longest_run", count(n)).alias("longest_run"), F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"))
