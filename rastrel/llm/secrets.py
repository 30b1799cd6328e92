"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

DataFrame functions only.  A text that no pattern can match yields one row and no
further work.  Matches become rows; their positions are running sums of the
lengths of matches and of the gaps between them.  Candidate strings are scanned
piece by piece by a window whose sum of c log c changes by the counts of the two
characters that enter and leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import spread

# The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_b64"]

#: Candidate strings of the entropy scan.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least window entropy, in bits, of hexadecimal candidates and of all others.
HEX_BITS, B64_BITS = 3.0, 3.8
WINDOW = 20
#: Windows of one piece; pieces overlap by a window less one, so every window lies in one of them.
PIECE = 512
#: Pieces that are known not to be secrets: a candidate is allowed if no window stands clear of them.
PIECES = r"(?i:example|placeholder|changeme|redacted|xxxx|dummy)|0?123456789|abcdefghij|(.)\1{5,}"
#: Whole candidates that are known not to be secrets; words have no digit but at their end.
#: Repeated groups are possessive: the engine loops over them instead of recursing, however long the candidate.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[A-Za-z]++(?:[-_/](?:[A-Za-z]{1,12}|[0-9]{1,12}|[A-Za-z]{1,8}[0-9]{1,4})(?=[-_/]|$))++$",
]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _piece_run(piece: Column, bits: Column, window: int) -> Column:
    """``struct(lo, hi)``: the first start and last end, in characters, of windows of at least ``bits``; -1 if none."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def slide(state: Column, j: Column) -> Column:
        enters = F.substr(piece, j, F.lit(1))

        def change(before: Column) -> Column:  # ``before``: the window until now
            leaves = F.when(j > window, F.left(before, F.lit(1))).otherwise(F.lit(""))
            held = lambda c: F.length(before) - F.length(F.replace(before, c, F.lit("")))
            gain = _let(held(enters), lambda n: F.get(table, n + 1) - F.get(table, n))
            loss = F.when(j > window, _let(held(leaves), lambda n: F.get(table, n) - F.get(table, n - 1))).otherwise(F.lit(0.0))
            return F.when(enters == leaves, F.lit(0.0)).otherwise(gain - loss)

        def result(total: Column) -> Column:
            high = (j >= window) & (F.lit(math.log2(window)) - total / window >= bits - 1e-9)
            return F.struct(total.alias("total"), F.when(high & (state["lo"] < 0), j - window).otherwise(state["lo"]).alias("lo"), F.when(high, j).otherwise(state["hi"]).alias("hi"))

        return _let(state["total"] + _let(F.substr(piece, F.greatest(j - window, F.lit(1)), F.least(j - 1, F.lit(window))), change), result)

    return F.aggregate(F.sequence(F.lit(1), F.length(piece)), start, slide, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))


def _entropy_run(hit: Column, bits: Column, window: int) -> Column:
    """The run of a whole candidate, of its pieces of ``PIECE`` windows each; nulls if none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(hit) - window, F.lit(0)), F.lit(PIECE))
    start = F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def add(state: Column, at: Column) -> Column:
        def both(got: Column) -> Column:
            lo, hi = F.when(got["lo"] >= 0, at + got["lo"]), F.when(got["hi"] >= 0, at + got["hi"])
            return F.struct(F.coalesce(state["lo"], lo).alias("lo"), F.coalesce(hi, state["hi"]).alias("hi"))

        return _let(_let(F.substr(hit, at + 1, F.lit(PIECE + window - 1)), lambda piece: _piece_run(piece, bits, window)), both)

    return F.aggregate(starts, start, add)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """``array<struct<kind, k, gap, hit>>`` of the leftmost non-overlapping matches."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.transform(zipped, lambda m, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(m["gap"]).alias("gap"), m["hit"].alias("hit")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hex_bits: float = HEX_BITS, b64_bits: float = B64_BITS, allow: list[str] | None = None) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``docs``: ``array<struct<first, rank, kind, last>>`` in code points, by start, then kind.

    Null and empty texts have no spans; an empty table gives an empty table;
    equal rows are scanned once and returned as often as they stand in the table;
    rows of one id with different texts are scanned one by one, and rows without
    an id like any other; other columns are not read.  Spans that start together
    are listed by kind.  Texts and candidates may have any length: a candidate is
    scanned in pieces, and what is shuffled are the matches, never the text.
    A candidate that an allow-list pattern matches as a whole, or in which no
    window stands clear of the harmless pieces, gets no entropy span; ``allow``
    stands for both lists (a variable-length repeated group in it should be
    possessive, or the regular expression engine recurses over long candidates).
    Pattern spans are never suppressed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast("array<struct<kind:int,k:int,gap:int,hit:string>>")
    parts = [F.when(text.rlike(pattern), _matches(text, pattern, kind)).otherwise(empty) for kind, pattern in enumerate([ASSIGN, ACCESS, HEX, CANDIDATE])]
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("k"), F.lit(0).alias("gap"), F.lit("").alias("hit")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A text is known by its id and 128 bits: the same key whenever a lost task is run again.
    rows = rows.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.explode(F.concat(mark, *parts)).alias("m"))
    rows = rows.select("doc_id", "t1", "t2", "m.*").groupBy("doc_id", "t1", "t2", "kind", "k", "gap", "hit").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("doc_id", "t1", "t2", "kind").orderBy("k")
    last = F.sum(F.col("gap") + F.length("hit")).over(order)
    rows = rows.repartition("doc_id", "t1", "t2").withColumn("last", last).withColumn("first", F.col("last") - F.length("hit"))
    clear = F.exists(F.split("hit", PIECES, -1), lambda x: F.length(x) >= window)
    allowed = ~clear & F.col("hit").rlike(PIECES) if allow is None else F.lit(False)
    for pattern in ALLOW if allow is None else allow:
        allowed = allowed | F.col("hit").rlike(pattern)
    is_hex = F.col("hit").rlike("^[0-9a-fA-F]+$")
    given = F.when(is_hex, F.struct(F.lower("hit").alias("hit"), F.lit(hex_bits).alias("bits"))).otherwise(F.struct(F.col("hit").alias("hit"), F.lit(b64_bits).alias("bits")))
    run = _let(given, lambda c: _entropy_run(c["hit"], c["bits"], window))
    rows = rows.withColumn("run", F.when((F.col("kind") == 3) & ~allowed, run)).withColumn("rank", F.when(F.col("kind") < 3, F.col("kind")).when(is_hex, 3).otherwise(4))
    names = F.array(*[F.lit(k) for k in KINDS])
    inner = F.length(F.regexp_extract("hit", ASSIGN, 2))
    plain = F.when((F.col("kind") >= 0) & (F.col("kind") < 3) & ((F.col("kind") > 0) | (inner >= ASSIGN_LEAST)), F.struct("first", "rank", F.get(names, F.col("rank")).alias("kind"), "last"))
    entropy = F.when(F.col("run.lo").isNotNull(), F.struct((F.col("first") + F.col("run.lo")).alias("first"), "rank", F.get(names, F.col("rank")).alias("kind"), (F.col("first") + F.col("run.hi")).alias("last")))
    found = rows.select("doc_id", "t1", "t2", "copies", F.coalesce(plain, entropy).alias("s")).groupBy("doc_id", "t1", "t2").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list("s")).alias("spans"))
    return spread(found, "copies", "doc_id", "t1", "t2").select("doc_id", "spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")
