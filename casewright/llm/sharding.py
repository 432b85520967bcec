"""Shards by jump consistent hashing.

A row's key decides its shard for every number of shards at once: the hash draws, from a
generator seeded by the key, the numbers of shards at which the row would move. With one
more shard a row stays or moves into the new shard, and no ring or table of ranges exists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import before, stored, text_or_empty

#: Multiplier of the published generator, as two 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD
MASK = 0xFFFFFFFF
#: Parts that a shard's rows are numbered in; with the shards, bounds the offsets table.
PARTS = 512


def _times(word: Column, factor: int) -> Column:
    """Low 32 bits of a product of 32-bit numbers, without leaving the signed 64 bits."""
    low, high = word.bitwiseAND(0xFFFF) * factor, F.shiftright(word, 16) * factor
    return (low + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _next_seed(high: Column, low: Column) -> tuple[Column, Column]:
    """``seed * multiplier + 1`` modulo 2**64 on 32-bit halves."""
    p0, p1 = low.bitwiseAND(0xFFFF) * MULTIPLIER_LOW, F.shiftright(low, 16) * MULTIPLIER_LOW
    lower = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(lower, 32) + F.shiftright(p1, 16)
    upper = carry + _times(low, MULTIPLIER_HIGH) + _times(high, MULTIPLIER_LOW)
    return upper.bitwiseAND(MASK), lower.bitwiseAND(MASK)


def jump_hash(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a 64-bit ``key`` among ``shards`` and ``shards + 1``.

    The number of draws is about ln(shards); ``steps`` is its largest possible value for few
    shards and is passed with a probability below 1e-30 for many, where the job fails rather
    than place a row wrongly.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    buckets = shards + 1
    steps = min(buckets, int(8 * math.log(buckets)) + 64)
    start = F.struct(
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).bitwiseAND(MASK).alias("high"), key.bitwiseAND(MASK).alias("low"),
    )

    def step(state: Column, _: Column) -> Column:
        at = state["next"]
        high, low = _next_seed(state["high"], state["low"])
        draw = (F.shiftright(high, 1) + 1).cast("double")
        jump = F.floor((at + 1).cast("double") * (F.lit(2147483648.0) / draw))
        moved = F.struct(
            F.when(at < shards, at).otherwise(state["shard"]).alias("shard"), at.alias("grown"), jump.alias("next"),
            high.alias("high"), low.alias("low"),
        )
        return F.when(at < buckets, moved).otherwise(state)

    def finish(state: Column) -> Column:
        done = state["next"] >= buckets
        return F.when(
            done, F.struct(state["shard"].cast("int").alias("shard"), state["grown"].cast("int").alias("grown"))
        ).otherwise(F.raise_error(F.lit("jump hash needs more steps")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, step, finish)


def assign(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", shards: int = 24) -> DataFrame:
    """Shard and slot of every row: the key columns and size, text_crc32, shard, slot, grown_shard.

    A key may hold nulls (null is a key of its own) and may repeat: rows with one key share a
    shard, which is the law of a key. A null text has size 8 and the checksum of the empty text.
    An empty table gives an empty result; other columns of ``df`` are not read, so their names
    do not matter. Slots count from 0 in each shard without gaps, in the order of a hash of key
    and text; equal rows take their slots in either order.
    """
    content = text_or_empty(text)
    place = jump_hash(F.xxhash64(*keys), shards)
    rows = df.select(
        *keys, (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
        place.alias("_place"), F.xxhash64(*keys, content).alias("_mix"),
    ).select(
        *keys, "size", "text_crc32", F.col("_place.shard").alias("shard"), F.col("_place.grown").alias("grown_shard"),
        "_mix", F.pmod("_mix", F.lit(PARTS)).alias("_part"),
    )
    slotted = before(stored(rows), "shard", "_part", ["_mix", *keys], F.lit(1).cast("long"), "slot")
    return slotted.select(*keys, "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), shards: int = 24, files: int = 8) -> None:
    """Write whole rows as Parquet, a folder per shard and up to ``files`` files in each."""
    place = jump_hash(F.xxhash64(*keys), shards)["shard"]
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    placed = df.withColumn("_shard", place)
    placed.repartition(shards * files, "_shard", spread).write.partitionBy("_shard").parquet(path)
