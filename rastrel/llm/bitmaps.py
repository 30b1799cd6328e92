"""Bitmaps of fixed size: rows that surely have no partner need not be shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh

#: Binary logarithm of the bits: 16 MB whatever the input.
BITMAP_LOG = 27


def mark(df: DataFrame, key: Column, keys: DataFrame, name: str, log_bits: int = BITMAP_LOG) -> DataFrame:
    """``df`` with a boolean ``name``: false where ``key`` is surely not among the one column of ``keys``.

    Keys are known by a hash; a null key of ``df`` is marked like any other.  The
    bitmap, ``2 ** log_bits`` bits (15 or more) in rows of 4 KB, is broadcast; it
    only saves work, so an exact join has to follow for the rows marked true.
    """
    if not 15 <= log_bits <= 32:
        raise ValueError("log_bits must lie in 15..32")
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << log_bits) - 1))
    at, bucket, bits = fresh(df, "bit_at", "bit_bucket", "bit_rows")
    own = keys.select(place(F.col(keys.columns[0])).alias("h"))
    table = own.groupBy(F.shiftright("h", 15).alias(bucket)).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(32767))).alias(bits))
    marked = df.withColumn(at, place(key)).join(F.broadcast(table), F.shiftright(F.col(at), 15) == F.col(bucket), "left")
    bit = F.col(at).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return marked.withColumn(name, F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop(at, bucket, bits)


def spread(df: DataFrame, copies: str, *key: str, piece: int = 1000) -> DataFrame:
    """Each row as often as ``copies`` says, without that column; what stands more than ``piece`` times is dealt to several tasks.

    Copies are made in two levels, so no array has more than ``piece`` or
    ``copies / piece`` numbers.
    """
    (part,) = fresh(df, "part_of_copies")
    last = F.expr(f"({copies} - 1) div {piece}")
    dealt = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(*key, part)
    own = F.least(F.lit(piece).cast("long"), F.col(copies) - F.col(part) * piece)
    return dealt.withColumn(part, F.explode(F.sequence(F.lit(1).cast("long"), own))).drop(part, copies)
