"""Rendezvous hashing of record keys over weighted shards (operator 3).

Each record scores every shard with ``weight / -ln(u)``, where u in (0, 1) is
a hash of (key, shard), and goes to the shard of the highest score.  A further
shard changes only the records for which it wins, so rows move only into it,
and a shard's share follows its weight.  The law is ``key``: key and shard
weights alone decide; sizes and texts do not.

Slots are numbered by ranges of (shard, key, text's crc32, size), each of which a task
sorts and counts on from the ranges before it (``numbered``), so neither a shard nor a
key with a third of the rows meets in one task.

Defined results: a null id is a key like another (all such rows share a
shard); repeated ids share a shard and get slots of their own; a null text has
size 16 and crc32 0; an empty table gives an empty table; further columns are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.tables import numbered

SHARDS = 40
_SCALE = float(2**53)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The winning shard of each key; ``weights[s]`` is the weight of shard s."""
    if not weights or any(not math.isfinite(w) or w <= 0 for w in weights):
        raise ValueError("weights are positive numbers")
    best = None
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + 0.5) / _SCALE
        # -ln(u) / weight is least where the score is highest
        entry = F.struct((-F.ln(u) / weight).alias("cost"), F.lit(shard).alias("shard"))
        best = [entry] if best is None else [*best, entry]
    return (F.least(*best) if len(best) > 1 else best[0])["shard"]


def assign(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    weights = weights or [1.0] * SHARDS
    data = F.col("text").cast("binary")
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(data), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    return numbered(placed, "doc_id", "text_crc32", "size", by=["shard"], name="slot")
