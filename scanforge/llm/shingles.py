"""Word shingles as hashed sets, and connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import WS, checkpointed, mix64

WORDS = 5
_IS_SPACE = np.isin(np.arange(256), list(WS))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: bytes of text whose shingles are made at once
SLICE = 1 << 19
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    global _powers
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(max(n, SLICE * 2), base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > SLICE * 4:  # a giant text: not kept
            return made
        _powers = made
    return _powers


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64)])
        word = mix64((sums[end] - sums[begin]) * inverse[begin] ^ ((end - begin).astype(np.uint64) << np.uint64(48)))
        n = len(word)
        mixed = np.zeros(n, np.uint64)
        for j in range(words):
            mixed[:max(0, n - j)] += word[j:] * power[2 * j + 3]
        gram = mix64(mixed)
        limits = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(begin, limits)
        out, a = [], 0
        for b in upto.tolist():
            if b - a >= words:
                out.append(np.unique(gram[a:b - words + 1]))
            elif b > a:
                out.append(mix64(np.array([sum(int(x) * int(power[2 * j + 3]) for j, x in enumerate(word[a:b])) % (1 << 64)], np.uint64) ^ np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
            a = b
    return out


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): the least vertex it is connected with."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("_m")).select("v", F.least("v", "_m").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("_near"))
        lower = labels.join(near, "v").select("v", F.col("root").alias("_old"), F.least("root", "_near").alias("_r"))
        up = labels.select(F.col("v").alias("_r"), F.col("root").alias("_up"))
        after = checkpointed(lower.join(up, "_r").select("v", "_old", F.least("_r", "_up").alias("root")))
        if after.filter("root <> _old").isEmpty():
            return after.select("v", "root")
        labels = after.select("v", "root")
