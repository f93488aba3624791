"""Rendezvous (highest-random-weight) sharding of stable record keys over weighted shards.

Every (key, shard) pair gets a pseudo-random u in (0, 1) from md5; the record goes to the shard with the smallest
``-ln(u) / weight``.  A shard's share follows its weight; a new shard only takes records into itself, a removed shard
only gives its own records away.  All of it is SQL expressions: no shuffle for the shard, one for the slots.

Defined cases: a null key counts as the empty text; equal keys share a shard; a null text has size 1 and the crc32 of
no bytes; equal hashes go to the smaller shard number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import stored, with_slots


def shard_cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u from the first 52 bits of md5(key # shard)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary")), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins the key; shards of weight 0 take nothing."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    entries = [F.struct(shard_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not entries:
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*entries))["shard"]


def shard_records(docs: DataFrame, weights: list[float], grown_weight: float | None = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and, with ``grown_weight``, the shard after one more was added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    grown = rendezvous(F.col("doc_id"), [*weights, grown_weight]) if grown_weight else F.lit(None).cast("int")
    sized = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(F.col("doc_id"), weights).alias("shard"), grown.alias("grown_shard"))
    kept = stored(sized, "shards")  # the texts are read once; what follows moves a few numbers per row
    return with_slots(kept, "shard", ["doc_id", "text_crc32", "size"], kept.count())
