"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table
(offset and step from two hashes of its name). The shards take turns; each
claims the first slot of its permutation that is still free. The full table
gives constant-time placement, differs in size between shards by one slot at
most, and moves few keys when a shard joins or leaves.

The table has ``slots`` rows (a parameter, checked against ``MAX_SLOTS``), so
its broadcast is bounded; documents are placed in one narrow pass.

Defined cases: a document without doc_id is placed by its text, so that such
rows spread too; equal ids go to the same shard; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import documents, text_or_empty

SHARDS, SLOTS, MAX_SLOTS = 64, 65_537, 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard that owns each slot."""
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MAX_SLOTS}")
    if not shards:
        raise ValueError("no shards")
    digests = [hashlib.sha256(x.encode()).digest() for x in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner, claimed = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + step[i]) % slots
            owner[slot] = i
            at[i] = (slot + step[i]) % slots
            claimed += 1
            if claimed == slots:
                return np.array(owner)


def shard_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64(text_or_empty()).cast("string")))


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(doc_id, slot, shard, shard_name): one row per row of ``docs``."""
    table = lookup_table(shards, slots)
    entries = docs.sparkSession.createDataFrame([(i, int(n), shards[n]) for i, n in enumerate(table)], "slot int, shard int, shard_name string")
    placed = docs.select("doc_id", F.pmod(F.xxhash64(shard_key()), F.lit(slots)).cast("int").alias("slot"))
    return placed.join(F.broadcast(entries), "slot").select("doc_id", "slot", "shard", "shard_name")


def write_shards(docs: DataFrame, path: str, shards: list[str], slots: int = SLOTS, files_per_shard: int = 8) -> None:
    """Write ``docs`` in one folder per shard; a shard's rows go through ``files_per_shard`` tasks."""
    table = lookup_table(shards, slots)
    entries = docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(table)], "_slot int, shard int")
    slot = F.pmod(F.xxhash64(shard_key()), F.lit(slots)).cast("int")
    out = docs.drop("shard").withColumn("_slot", slot).join(F.broadcast(entries), "_slot").withColumn("_file", F.pmod("_slot", F.lit(files_per_shard)))
    out.repartition("shard", "_file").drop("_slot", "_file").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir), [f"shard-{i:03d}" for i in range(SHARDS)])
