"""Sharding by weighted rendezvous hashing of a stable record key.

Every shard gives every key a score that depends on the key, the shard number
and the shard's weight alone; the best score wins.  Adding a shard therefore
only moves the rows that the new shard wins.  All work is in built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

SLOT_PARTS = 1024  # pieces a shard is numbered in; fixed, so the offsets table stays small


def _hash32(key: Column, shard: int, seed: str) -> Column:
    """32 bits of md5(seed:key:shard div 4); one digest serves four shards."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(f":{shard // 4}")).cast("binary"))
    return F.conv(F.substring(digest, 8 * (shard % 4) + 1, 8), 16, 10).cast("long")


def rendezvous_shard(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """Number of the shard that wins ``key``; ties go to the smaller number.

    The score of a shard is -ln(u) / weight with u uniform in (0, 1); the
    smallest wins, which gives each shard its weight's share of the keys.  With
    equal weights the largest u wins, so no logarithm is taken.  A null key is
    the key "" and is placed like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and at least one is needed")
    key = F.coalesce(key.cast("string"), F.lit(""))
    equal = len(set(weights)) == 1

    def score(k: int) -> Column:
        h = _hash32(key, k, seed)
        if equal:
            return -h
        return -F.log((h + F.lit(0.5)) / F.lit(2.0 ** 32)) / F.lit(float(weights[k]))

    best = [F.struct(score(k).alias("s"), F.lit(k).alias("k")) for k in range(len(weights))]
    return (F.least(*best) if len(best) > 1 else best[0])["k"].cast("int")


def shard(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
          grown_weights: Sequence[float] | None = None, seed: str = "shard") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's rows from 0 without gaps, by hashed piece, key,
    checksum and size.  A shard is numbered in SLOT_PARTS pieces whose counts
    give the offsets, so no shard passes through one task.  ``grown_shard`` is
    the shard under ``grown_weights`` (null without them).

    Null text: size 1, checksum 0.  Null key: placed as key "".  Repeated rows
    each get a slot.  An empty table gives an empty result.  Only the key and
    text columns are read, so other columns may have any name.
    """
    k = F.col(key)
    txt = text_or_empty(text)
    grown = (rendezvous_shard(k, grown_weights, seed) if grown_weights else F.lit(None)).cast("int")
    part = F.pmod(F.crc32(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(":"),
                                   F.crc32(txt.cast("binary")).cast("string")).cast("binary")),
                  F.lit(SLOT_PARTS)).cast("int")
    rows = df.select(
        k.alias(key), (F.octet_length(txt) + 1).cast("long").alias("size"),
        F.crc32(txt.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous_shard(k, weights, seed).alias("shard"), grown.alias("grown_shard"),
        part.alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x SLOT_PARTS rows, whatever the input holds
    offsets = F.broadcast(counts.select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("shard", "part").orderBy(key, "text_crc32", "size")
    return (rows.withColumn("i", F.row_number().over(within) - 1)
            .join(offsets, ["shard", "part"])
            .select(key, "size", "text_crc32", "law", "shard",
                    (F.col("offset") + F.col("i")).cast("long").alias("slot"), "grown_shard"))
