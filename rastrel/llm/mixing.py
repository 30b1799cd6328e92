"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

#: Exponents tried at once, and rounds; each narrows the range by the number of exponents less one.
TRIES, ROUNDS = 33, 7
#: Documents of a block, on average.
BLOCK_DOCS = 256


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """``(doc_id, source, n_tokens, place)``: a row counts its words, at least 1; ``place`` hashes its id, or its text if it has none."""
    words = F.greatest(F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")
    key = F.col(id_col).cast("long")
    place = F.when(key.isNull(), F.xxhash64(F.lit(seed), F.col(text_col).cast("string"))).otherwise(F.xxhash64(key, F.lit(seed)))
    return docs.select(key.alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("n_tokens"), place.alias("place"))


def find_exponent(shares: DataFrame, target_entropy: float | None, most_repeats: float | None, budget_share: float | None) -> tuple[float, float]:
    """The exponent in [0, 1] and the sum of the shares to it, for ``shares(p)``.

    Entropy falls as the exponent rises, and so do the repetitions of the
    smallest source.  The result is the largest exponent with at least
    ``target_entropy``, raised if need be to the smallest with at most
    ``most_repeats``.  ``budget_share``: the budget as a multiple of all tokens;
    None: the budget that reads every source at least once.  Each round sends
    a few sums for each of ``TRIES`` exponents to the driver, never the sources.
    """

    def sums(tries: list[float]) -> list[tuple[float, float, float]]:
        rows = shares.select("p", F.explode(F.array(*[F.lit(a) for a in tries])).alias("a"))
        power = F.pow("p", F.col("a"))
        got = rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"), F.min("p").alias("low"), F.max("p").alias("high")).collect()
        out = {}
        for r in got:
            entropy = math.log(r["z"]) - r["a"] * r["zl"] / r["z"]
            # weight / share is p ** (a - 1) / z: largest for the smallest share
            most, least = r["low"] ** (r["a"] - 1) / r["z"], r["high"] ** (r["a"] - 1) / r["z"]
            out[r["a"]] = (entropy, most * (1 / least if budget_share is None else budget_share), r["z"])
        return [out[a] for a in tries]

    def search(meets, largest: bool) -> float:
        """The end of the exponents that meet a condition which holds on one side."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            tries = [low + (high - low) * k / (TRIES - 1) for k in range(TRIES)]
            ok = [meets(x) for x in sums(tries)]
            if largest:
                k = max((i for i, x in enumerate(ok) if x), default=0)
                low, high = tries[k], tries[min(k + 1, TRIES - 1)]
            else:
                k = min((i for i, x in enumerate(ok) if x), default=TRIES - 1)
                low, high = tries[max(k - 1, 0)], tries[k]
            if low == high:
                break
        return low if largest else high

    exponent = 1.0
    if target_entropy is not None:
        exponent = search(lambda x: x[0] >= target_entropy - 1e-12, True)
    if most_repeats is not None:
        least = search(lambda x: x[1] <= most_repeats * (1 + 1e-12), False)
        exponent = max(exponent, least) if target_entropy is not None else least
    return exponent, sums([exponent])[0][2]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, most_repeats: float | None = 4.0, budget_share: float | None = 1.0, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, block, copies)`` for each row of ``docs``: how often the mixture reads it.

    ``target_entropy``: a share of the largest possible, the logarithm of the
    number of sources.  A source's budget is its weight times the budget.  Whole
    epochs of it give each document one copy each; the rest is filled by its
    blocks, in the order of a permutation, and by the documents of the block at
    the border, while they fit.  Blocks are drawn by the hash of the id (of the
    text, if there is no id), so no task needs a whole source; ties of the hash
    are broken by the id.  A null source is a source of its own; null and empty
    texts count one token, and texts of any length are counted whole; an empty
    table gives an empty table; rows of a source that repeat an id, or that have
    none and repeat a text, share their fate; other columns are not read.
    """
    return _mixed(docs, id_col, source_col, text_col, target_entropy, most_repeats, budget_share, seed, scratch).drop("place")


def _mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, most_repeats: float | None = 4.0, budget_share: float | None = 1.0, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_rows(docs, id_col, source_col, text_col, seed), "rows")
    names = scratch.save(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")
    total = names.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return docs.sparkSession.createDataFrame([], "doc_id long, source string, n_tokens long, block long, place long, copies long")
    shares = names.select((F.col("tokens") / F.lit(float(total["t"]))).alias("p"))
    exponent, z = find_exponent(shares, None if target_entropy is None else target_entropy * math.log(total["n"]), most_repeats, budget_share)
    p = F.col("tokens") / F.lit(float(total["t"]))
    ratio = F.pow(p, F.lit(exponent - 1)) / F.lit(z)  # weight over share
    if budget_share is None:
        lowest = names.agg(F.max("tokens").alias("t")).first()["t"] / total["t"]
        budget_share = 1 / (lowest ** (exponent - 1) / z)
    # Readings of each source, and the tokens of the last, partial one.
    reads = F.round(ratio * F.lit(budget_share), 9)
    plan = names.select(F.col("source").alias("of"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"), F.floor(reads).alias("epochs"), F.floor((reads - F.floor(reads)) * F.col("tokens")).alias("rest"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod("place", "blocks"))

    turn = F.xxhash64("source", "block", "epochs", F.lit(seed + 1))
    # The permutation's order, in 4096 stretches: sums before a stretch, and within it.
    blocks = rows.groupBy("source", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("tokens")).withColumn("turn", turn).withColumn("stretch", F.shiftright("turn", 52))
    blocks = scratch.save(blocks, "turns")
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("source", "stretch").agg(F.sum("tokens").alias("all"))
    bases = bases.select(F.col("source").alias("of"), F.col("stretch").alias("at"), F.coalesce(F.sum("all").over(ahead("source").orderBy("stretch")), F.lit(0)).alias("base"))
    blocks = blocks.join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
    blocks = blocks.withColumn("left", F.col("rest") - F.col("base") - F.coalesce(F.sum("tokens").over(ahead("source", "stretch").orderBy("turn", "block")), F.lit(0)))
    blocks = scratch.save(blocks.select(F.col("source").alias("of"), F.col("block").alias("in_block"), "tokens", "left"), "blocks")

    placed = rows.join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block"))).drop("of", "in_block")
    sure = placed.where((F.col("left") <= 0) | (F.col("tokens") <= F.col("left"))).withColumn("more", (F.col("left") > 0).cast("long"))
    border = placed.where((F.col("left") > 0) & (F.col("tokens") > F.col("left")))
    # Equal keys are one unit, so that a window holds a block's different keys only.
    unit = border.groupBy("source", "block", "place", "doc_id", "left").agg(F.sum("n_tokens").alias("size"))
    until = F.sum("size").over(Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    unit = unit.select(F.col("source").alias("of"), F.col("place").alias("at"), F.col("doc_id").alias("key"), (until <= F.col("left")).cast("long").alias("more"))
    border = border.join(unit, F.col("source").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("key")))
    columns = ["doc_id", "source", "n_tokens", "block", "place", (F.col("epochs") + F.col("more")).alias("copies")]
    return sure.select(*columns).unionByName(border.select(*columns))


def realise(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture reads it, with all their columns.

    Rows are never multiplied by others of their id: those of a source that
    repeat an id, or that have none and repeat a text, are each read equally
    often.  Null sources, null and empty texts count as in ``mix_sources``; an
    empty table gives an empty table.
    """
    key, of, at, n, k = fresh(docs, "mix_id", "mix_source", "mix_place", "mix_copies", "mix_copy")
    copies = _mixed(docs, id_col, source_col, text_col, seed=seed, **how).groupBy(F.col("doc_id").alias(key), F.col("source").alias(of), F.col("place").alias(at)).agg(F.min("copies").alias(n)).where(F.col(n) > 0)
    own = F.col(id_col).cast("long")
    place = F.when(own.isNull(), F.xxhash64(F.lit(seed), F.col(text_col).cast("string"))).otherwise(F.xxhash64(own, F.lit(seed)))
    joined = docs.join(copies, (place == F.col(at)) & own.eqNullSafe(F.col(key)) & F.col(source_col).cast("string").eqNullSafe(F.col(of)))
    return joined.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*docs.columns)
