"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable key and the number of shards decide the shard; there is no ring and no table.  With one more shard, a row stays
or goes to the new one, which 1 in n + 1 rows do.  The generator is the 64-bit congruential one of the published algorithm;
its products modulo 2**64 are made of 32-bit halves, because integer overflow is an error in ANSI mode.

A null key is hashed as the empty text.  Equal keys share a shard.  Slots number the rows of a shard from 0 without gaps, in
the order of hashed blocks; rows with equal keys get different slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the multiplier of the published algorithm, 2862933555777941757, as its two halves of 32 bits.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 666578662, 2276503805
MASK = 0xFFFFFFFF
# Rows of one shard that are numbered in one task, about.
BLOCK_ROWS = 4000


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64, as halves."""
    a, b = F.lit(MULTIPLIER_HIGH).cast("long"), F.lit(MULTIPLIER_LOW).cast("long")
    low0, low1 = low.bitwiseAND(0xFFFF), F.shiftright(low, 16)
    high0, high1 = high.bitwiseAND(0xFFFF), F.shiftright(high, 16)
    p1 = low1 * b
    s = low0 * b + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + 1
    cross = (low0 * a) + F.shiftleft((low1 * a).bitwiseAND(0xFFFF), 16) + high0 * b + F.shiftleft((high1 * b).bitwiseAND(0xFFFF), 16)
    return (F.shiftright(s, 32) + F.shiftright(p1, 16) + cross).bitwiseAND(F.lit(MASK)), s.bitwiseAND(F.lit(MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key."""
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(MASK)).alias("high"), key.bitwiseAND(F.lit(MASK)).alias("low"))

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        jump = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1)))
        moved = F.struct(s["j"].alias("b"), jump.cast("long").alias("j"), high.alias("high"), low.alias("low"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def after(steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    # About ln(shards) jumps are made, and never more than shards; the long walk is only for rows that the short one leaves.
    short = min(shards, 8 + 4 * math.ceil(math.log(shards + 1)))
    walked = after(short)
    if short == shards:
        return walked["b"].cast("int")
    return F.when(walked["j"] >= shards, walked["b"]).otherwise(after(shards)["b"]).cast("int")


def shard(rows: DataFrame, key: Column, shards: int, out: str = "shard") -> DataFrame:
    """`rows` with the shard of their key, and `grown_` + out: the shard if there is one more."""
    stable = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")))
    return rows.withColumn("_key", stable).withColumn(out, jump_hash(F.col("_key"), shards)).withColumn(
        f"grown_{out}", jump_hash(F.col("_key"), shards + 1)).drop("_key")


def numbered(rows: DataFrame, shard_column: str, order: list[str], blocks: int, out: str = "slot") -> DataFrame:
    """`rows` with their number in the shard.  Blocks of a shard are ordered apart; counts of the blocks before are added."""
    staged = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = staged.groupBy(shard_column, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard_column).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(shard_column, "_block").orderBy(*order)
    return staged.withColumn("_own", F.row_number().over(own)).join(offsets, [shard_column, "_block"]).withColumn(
        out, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_block", "_own", "_before")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document; texts are not shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    blocks = max(1, math.ceil(docs.count() / shards / BLOCK_ROWS))
    placed = numbered(shard(small, F.col("doc_id"), shards), "shard", ["doc_id", "text_crc32", "size"], blocks)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
