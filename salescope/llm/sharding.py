"""Jump consistent hashing: stable keys to shards without a ring table.

The published loop (Lamping & Veach, "A Fast, Minimal Memory, Consistent Hash
Algorithm") is

    b = -1; j = 0
    while j < shards:
        b = j
        key = key * 2862933555777941757 + 1            (mod 2^64)
        j = floor((b + 1) * 2^31 / ((key >> 33) + 1))
    return b

``j`` grows in every step, so ``shards`` steps are always enough: the loop is a
fold over a constant array whose state stops changing once ``j >= shards``.  The
64-bit product is done on two 32-bit limbs held in longs, because ANSI
arithmetic raises an error where the algorithm wraps around.  Everything is a
built-in expression of one projection: no shuffle decides a shard.

A bigger shard count continues the same walk, so appending a shard moves rows
into the new shard only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MULTIPLIER = 2862933555777941757          # fixed value of the published algorithm
_M32 = (1 << 32) - 1


_RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * multiplier + 1 modulo 2^64, on 32-bit limbs without overflow."""
    c_hi, c_lo = _MULTIPLIER >> 32, _MULTIPLIER & _M32
    m16, m32 = F.lit(0xFFFF), F.lit(_M32)
    low = lo.bitwiseAND(m16) * F.lit(c_lo)                              # < 2^48
    high = F.shiftright(lo, 16) * F.lit(c_lo)                           # < 2^48, worth 2^16 more
    s = low.bitwiseAND(m32) + F.shiftleft(high.bitwiseAND(m16), 16) + F.lit(1)
    carry = F.shiftright(s, 32) + F.shiftright(low, 32) + F.shiftright(high, 16)
    cross = ((lo * F.lit(c_hi)).bitwiseAND(m32)                         # lo * c_hi < 2^62
             + hi * F.lit(c_lo & 0xFFFF)                                # < 2^48
             + F.shiftleft((hi * F.lit(c_lo >> 16)).bitwiseAND(m16), 16))
    return (carry + cross).bitwiseAND(m32), s.bitwiseAND(m32)


def _limbs(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_M32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. ``shards`` - 1 of a long key (null key: the key 0)."""
    hi, lo = _limbs(F.coalesce(key.cast("long"), F.lit(0).cast("long")))
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
                     hi.alias("hi"), lo.alias("lo"))

    def step(s, _):
        hi, lo = _next_key(s.hi, s.lo)
        jump = F.floor((s.j + 1).cast("double")
                       * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(s.j.alias("b"), jump.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s.j < shards, moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda s: s.b.cast("int"))


def _spread(key: Column, parts: int) -> Column:
    """An even spread of keys over ``parts``: the high bits of the first step."""
    hi, _ = _next_key(*_limbs(F.coalesce(key.cast("long"), F.lit(0).cast("long"))))
    return F.pmod(F.shiftright(hi, 1), F.lit(parts))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
               rows_per_part: int = 500_000, carry: list[str] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row per input row.

    ``shard`` follows from the id and the shard count alone (law ``key``);
    ``grown_shard`` is the shard with one more.  ``size`` is the UTF-8 bytes of
    the text (null: 0) plus 16, ``text_crc32`` its unsigned CRC (null: that of
    the empty text).  ``slot`` numbers the rows of a shard from 0 without gaps.

    A shard may hold any share of the corpus, so slots are not numbered by one
    window per shard: each shard is cut into parts of about ``rows_per_part``
    rows by key, parts are counted (one row each) and shifted by the running
    total, and rows are numbered inside their part.  Order inside a part: id,
    size, crc; equal rows are interchangeable.  A null id behaves as key 0.
    ``carry`` names input columns to append (those named like a result column
    are left out).  An empty table gives an empty result.
    """
    more = [c for c in carry if c not in _RESULT]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in more]).alias("carried"))
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    parts = max(1, math.ceil(rows.count() / shards / rows_per_part))
    rows = rows.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        _spread(F.col("doc_id"), parts).alias("part"), "carried")
    in_part = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row per part: its running total is a window over a shard's parts
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("in_part", F.row_number().over(in_part).cast("long") - 1)
    return (numbered.join(offsets, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("in_part") + F.col("offset")).alias("slot"), "grown_shard",
                    *[F.col(f"carried.`{c}`") for c in more]))
