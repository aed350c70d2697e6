"""Mixing sources to target weights with shuffled fixed-length blocks.

The words of a source, documents one after another, are packed into blocks of
``block`` words. The mix of a source is a run of slots; slot ``j`` of epoch
``e`` holds block ``perm(source, e)(j)``, a keyed Feistel permutation of the
block numbers, so a block is drawn once per epoch. Each slot throws a hashed
die for its output shard: the counts per (shard, source) so drawn are
multinomial, without a table of counts on the driver. Slots and blocks meet by
(source, block number). The last slot of a source is cut to the words that are
still wanted, so the taken words equal the rounded target.

Offsets of documents in their source come from prefix sums in two levels
(buckets of a source, then documents of a bucket), about the square root of the
table each, so a source with a third of all rows is summed by many tasks. The
only thing collected is the table of sources (one row each, at most
``MAX_SOURCES``).

Defined cases: null text has no words and null source is a source of its own;
a document without words takes none; a table without words takes none; every
row gives one row; repeated rows are packed one after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.llm.common import checkpointed, documents, mix64, text_or_empty

WEIGHTS, SHARE, MAX_REPEAT = (5, 2, 1), 1.5, 2
BLOCK, SHARD_BLOCKS, SEED, MAX_SOURCES = 1024, 4096, 20_24, 1_000_000
_ROUNDS = 4


# --- keyed permutation of 0..n-1 (vectorised) ---------------------------------------------------------------------------------

def _halves(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, key: np.ndarray, half: int, forward: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for k in range(_ROUNDS) if forward else reversed(range(_ROUNDS)):
        if forward:
            left, right = right, left ^ (mix64(right ^ mix64(key + np.uint64(k))) & mask)
        else:
            left, right = right ^ (mix64(left ^ mix64(key + np.uint64(k))) & mask), left
    return (left << h) | right


def permute(x: np.ndarray, n: int, key: int, forward: bool = True) -> np.ndarray:
    """Permutation of 0..n-1 chosen by ``key``; values that leave the range walk on along their cycle."""
    out = np.asarray(x, np.uint64).copy()
    half, keys = _halves(n), np.uint64(key & ((1 << 64) - 1))
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            out[todo] = _feistel(out[todo], np.full(int(todo.sum()), keys), half, forward)
            todo = out >= np.uint64(n)
    return out.astype(np.int64)


def epoch_key(seed: int, source_no: int, epoch: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([seed * 1_000_003 + source_no * 31 + epoch], np.uint64))[0])


# --- targets ------------------------------------------------------------------------------------------------------------------

def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MAX_REPEAT) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight; none above ``most`` times its size, the excess reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, capped = share * sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        free = sum(x for x, c in zip(w, capped, strict=True) if not c)
        out = [most * s if c else left * x / free for s, x, c in zip(sizes, w, capped, strict=True)]
        over = [not c and t > most * s for t, s, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return [float(x) for x in out]
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def source_plan(rows: list[tuple], weights: tuple = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = SEED) -> list[tuple]:
    """(source, no, size, target, blocks, full epochs, words left for the last epoch, slots in it, place of the short block in it)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    plan = []
    for no, ((source, size), target) in enumerate(zip(rows, targets([s for _, s in rows], weights, share), strict=True)):
        n, words = -(-size // block), math.floor(target + 0.5)
        epochs, rest = divmod(words, size) if size else (0, 0)
        short = int(permute(np.array([n - 1]), n, epoch_key(seed, no, epochs), forward=False)[0]) if n else 0
        lacking = n * block - size
        slots = -(-rest // block)
        if slots > short:
            slots = -(-(rest + lacking) // block)
        plan.append((source, no, size, target, n, epochs, rest, slots, short))
    return plan


_PLAN = "_source string, _no int, source_size bigint, target double, _n bigint, _epochs int, _rest bigint, _slots bigint, _short bigint"


# --- the mix ------------------------------------------------------------------------------------------------------------------

def word_count():
    return F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _draw(block: int, seed: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, n, epoch, j, last, rest, short, lacking = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8))
            at = np.empty(len(no), np.int64)
            die = np.empty(len(no), np.int64)
            for pair in {*zip(no.tolist(), epoch.tolist(), strict=True)}:
                m = (no == pair[0]) & (epoch == pair[1])
                key = epoch_key(seed, *pair)
                at[m] = permute(j[m], int(n[m][0]), key)
                with np.errstate(over="ignore"):
                    die[m] = (mix64(j[m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key)) % np.uint64(shards)).astype(np.int64)
            before = j * block - lacking * (j > short)
            take = np.where(last == 1, np.minimum(block, rest - before), block)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (no, epoch, j, at, die, take)],
                                             names=["_no", "epoch", "slot", "block", "shard", "take"])

    return run


def draw_slots(spark: SparkSession, plan: list[tuple], block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(_no, epoch, slot, block, shard, take): every slot of the mix; ``take`` words of the block are used."""
    total = sum(p[4] * p[5] + p[7] for p in plan)
    runs = [(no, n, e, p8 if e == epochs else 0, int(e == epochs), slots if e == epochs else n, rest, n * block - size)
            for _, no, size, _, n, epochs, rest, slots, p8 in plan for e in range(epochs + 1)]
    runs = spark.createDataFrame([r for r in runs if r[5]], "_no bigint, _n bigint, _epoch bigint, _short bigint, _last bigint, _count bigint, _rest bigint, _lacking bigint")
    step = 1 << 14
    parts = runs.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1, F.lit(step).cast("bigint"))))
    # the number is named: few rows that stand for many slots aren't folded into one task
    slots = parts.repartition(max(1, -(-total // step)), "_no", "_epoch", "_from").withColumn(
        "_j", F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col("_count")) - 1)))
    args = slots.select("_no", "_n", "_epoch", "_j", "_last", "_rest", "_short", "_lacking")
    return args.mapInArrow(_draw(block, seed, max(1, -(-total // shard_blocks))), "_no bigint, epoch bigint, slot bigint, block bigint, shard bigint, take bigint")


def packed(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, share: float = SHARE, seed: int = SEED) -> tuple[DataFrame, list[tuple]]:
    """Documents with their place in the word stream of their source, and the plan of the sources."""
    spark = docs.sparkSession
    sized = checkpointed(docs.select("doc_id", F.col("source").alias("_source"), word_count().alias("size"), F.xxhash64(text_or_empty()).alias("_th")))
    found = sized.groupBy("_source").agg(F.sum("size"), F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = source_plan([(r[0], r[1]) for r in found], weights, share, block, seed)
    buckets = max(1, math.isqrt(sum(r[2] for r in found)))
    table = F.broadcast(spark.createDataFrame(plan, _PLAN))
    rows = sized.join(table, sized["_source"].eqNullSafe(table["_source"])).drop("_source")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_th"), F.lit(buckets)))
    sums = rows.groupBy("_no", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_no", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_no", "_bucket").orderBy("doc_id", "_th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["_no", "_bucket"])
    return rows.withColumn("_start", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))), plan


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Pieces of the mix: (shard, epoch, slot, block, doc_id, first, words) and the document's columns.

    A piece is the part of a document that one slot uses: ``words`` words from
    word ``first`` on. Documents that no slot uses have one row without shard.
    """
    rows, plan = packed(docs, block, weights, share, seed)
    slots = draw_slots(docs.sparkSession, plan, block, SHARD_BLOCKS, seed)
    size, start = F.col("size"), F.col("_start")
    spans = F.when(size > 0, F.sequence(F.floor(start / block), F.floor((start + size - 1) / block)))
    parts = rows.withColumn("block", F.explode_outer(spans))
    parts = parts.withColumn("_lo", F.greatest(start, F.col("block") * block)).withColumn("_hi", F.least(start + size, (F.col("block") + 1) * block))
    # the planner takes the slots for as small as the table of sources they are made from; they grow with the words
    used = parts.join(slots.hint("merge"), ["_no", "block"], "left")
    words = F.least(F.col("_hi"), F.col("block") * block + F.coalesce("take", F.lit(0))) - F.col("_lo")
    return used.select("doc_id", "_th", "_no", "_start", "size", "source_size", "target", "shard", "epoch", "slot", "block",
                       (F.col("_lo") - start).alias("first"), F.greatest(F.coalesce(words, F.lit(0)), F.lit(0)).cast("bigint").alias("words"))


def taken_words(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (and the hash of its text)."""
    pieces = mix(docs)
    sure = F.when(F.col("size") > 0, F.col("_start"))  # tells repeated rows apart; rows without words all take none
    keys = ["doc_id", "_th", "_no", "size", "source_size", "target"]
    some = pieces.filter("size > 0").groupBy(*keys, sure.alias("_start")).agg(F.sum("words").alias("taken"))
    none = pieces.filter("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return some.drop("_start").unionByName(none)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated by how often the mix takes them.

    taken / size is rounded up or down by a hash of the document, so the
    expected words stay the target's; a document that the mix passes over goes.
    """
    taken = taken_words(docs).groupBy(F.col("doc_id").alias("_d"), F.col("_th").alias("_h")).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_times"))
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("_th", F.xxhash64(text_or_empty()))
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")))
    luck = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "_th"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(F.col("_times") + luck).cast("int")
    out = joined.withColumn("_copies", copies).filter("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select("doc_id", "text", "lang", "source", "n_chars")
