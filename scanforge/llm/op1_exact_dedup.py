"""Exact dedup with Patricia-trie owners.

A compressed radix trie maps full byte strings to an owner (the identifier
that stays) and a count. It is used twice:

* each input partition inserts its rows and emits one row per distinct text,
  so a text that a third of all documents share crosses the network once per
  partition;
* those rows meet by (length, content hash); sorted by that key, a second trie
  merges them.

Both hold a bounded number of bytes. Over the budget, the first trie spills
its largest subtrees as partial rows (they merge later); the second spills the
subtrees of keys that the sorted input has passed, which are final.

Defined cases: null counts as empty; every row is returned; a null doc_id
loses to any other; of rows that agree in doc_id and text exactly one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import documents, text_or_empty

#: bytes of text that one trie holds before it spills
BUDGET = 48 << 20


class Node:
    __slots__ = ("label", "kids", "owner", "count", "bytes")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.count, self.bytes = label, {}, None, 0, 0


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Keys must not be proper prefixes of each other (ours start with hash and length)."""

    def __init__(self, largest: bool):
        self.root, self.better = Node(b""), max if largest else min

    def __len__(self) -> int:
        return self.root.bytes

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                at = len(key)
            else:
                same = common_prefix(kid.label, key, at)
                if same < len(kid.label):  # split the edge
                    upper = Node(kid.label[:same])
                    upper.bytes, kid.label = kid.bytes, kid.label[same:]
                    upper.kids[kid.label[0]] = kid
                    node.kids[key[at]] = kid = upper
                at += same
            path.append(kid)
            node = kid
        if not node.count:
            for x in path:
                x.bytes += len(key)
        node.count += count
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)

    def leaves(self, top: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(top or self.root, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.count:
                yield key, node.owner, node.count
            stack += [(k, key) for k in node.kids.values()]

    def spill(self, keep: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Cut off the largest subtrees below the root until ``keep`` bytes are left."""
        for first, kid in sorted(self.root.kids.items(), key=lambda x: -x[1].bytes):
            if self.root.bytes <= keep:
                return
            del self.root.kids[first]
            self.root.bytes -= kid.bytes
            yield from self.leaves(kid)


_PARTIAL = "_h bigint, _len bigint, _text binary, _owner bigint, _n bigint"
_OWNERS = "text_sha256 string, keep_id bigint, group_size bigint"


def _key(h: int, text: bytes) -> bytes:
    return h.to_bytes(8, "big", signed=True) + len(text).to_bytes(8, "big") + text


def _insert_partition(largest: bool, budget: int):
    def rows(found) -> Iterator[pa.RecordBatch]:
        part, held = [], 0
        for key, owner, n in found:
            part.append((int.from_bytes(key[:8], "big", signed=True), len(key) - 16, key[16:], owner, n))
            held += len(key)
            if held > (4 << 20):
                yield _batch(part)
                part, held = [], 0
        if part:
            yield _batch(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest)
        for batch in batches:
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                trie.insert(_key(h, text.as_buffer().to_pybytes()), doc)
                if len(trie) > budget:
                    yield from rows(trie.spill(budget // 2))
        yield from rows(trie.leaves())

    return run


def _batch(part: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*part, strict=True))
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["_h", "_len", "_text", "_owner", "_n"])


def _merge_owners(largest: bool, budget: int):
    def rows(trie: PatriciaTrie) -> pa.RecordBatch:
        found = [(hashlib.sha256(key[16:]).hexdigest(), owner, n) for key, owner, n in trie.leaves()]
        cols = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64()], strict=True)],
                                          names=["text_sha256", "keep_id", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = PatriciaTrie(largest), None
        for batch in batches:
            for h, n_bytes, text, owner, n in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2),
                                                  *(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
                if (h, n_bytes) != current:
                    if len(trie) > budget:  # every key so far is complete
                        yield rows(trie)
                        trie = PatriciaTrie(largest)
                    current = (h, n_bytes)
                trie.insert(_key(h, text.as_buffer().to_pybytes()), owner, n)
        if len(trie):
            yield rows(trie)

    return run


def owners(docs: DataFrame, largest: bool = False, budget: int = BUDGET) -> DataFrame:
    """(text_sha256, keep_id, group_size): one row per distinct text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("_text"))
    partial = rows.mapInArrow(_insert_partition(largest, budget), _PARTIAL)
    met = partial.repartition("_len", "_h").sortWithinPartitions("_h", "_len")
    return met.mapInArrow(_merge_owners(largest, budget), _OWNERS)


def exact_dedup(docs: DataFrame, largest: bool = False, budget: int = BUDGET) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The trie decides owners and sizes; the digest carries them back to the
    rows, so the text itself is shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"))
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_copies"))
    out = rows.join(owners(docs, largest, budget), "text_sha256")
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    kept = (F.col("_i") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), largest=True)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
