"""Placement of rows on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots; a prime, far above the number of shards so that shares differ by little.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """For every slot the number of the shard that owns it.

    A shard's order of preference is offset + k * skip modulo the prime number of
    slots, both from its name, hence a permutation. Shards take turns, each
    claiming its next free slot, so shares differ by one at most, and a shard
    that comes or goes moves few other slots. The table has a fixed size, so it
    is made on the driver.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be named, distinct and no more than slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    owner = np.full(slots, -1, np.int32)
    place = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    left = slots
    while left:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            owner[place[i]] = i
            left -= 1
            if not left:
                break
    return owner


def place(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """Add slot and shard to docs (columns of these names are replaced).

    The slot is md5 of the key as text, its first 60 bits modulo the number of
    slots; the table is broadcast (its size is the parameter slots). Rows with a
    null key take the key '' and so share a slot; equal keys always meet. An
    empty table gives no rows. Nothing is shuffled.
    """
    owner = lookup_table(shards, slots)
    spark = docs.sparkSession
    lookup = spark.createDataFrame(
        [(i, shards[o]) for i, o in enumerate(owner.tolist())], "slot long, shard string"
    )
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary"))
    slot = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)
    return docs.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(lookup), "slot", "left")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, with the size of its text in bytes."""
    from tessera.llm.common import table

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    return place(docs).select("doc_id", "slot", "shard", "n_bytes")

