"""Ranked lexical search with bag deduplication.

Benchmark items are queries against all documents. A document matters to the
ranking only through its counts of the items' terms and its length measure m,
so documents that agree in both form one class, which is scored once.

1. One pass over the texts: number of terms and the counts of the items' terms
   (the bag). Bags are written to the shared folder.
2. One pass over the bags: N, L and the document frequencies; a task returns
   one sum a term.
3. Documents are hashed by (bag, m) and grouped by the bytes themselves, so a
   class holds identical bags only. A class keeps its ``k`` least doc_ids: no
   list of ``k`` documents can hold more of it. Ranks are taken in salted
   parts first, so a class of any size is spread.
4. Each class is scored once, in blocks: counts times weights as a matrix
   against the items. A task keeps the best ``k`` classes an item.
5. The best classes are expanded by ascending doc_id and ranked.

Items are handled in blocks of about ``BLOCK_BYTES`` of item text (by a hash),
which bounds the vocabulary that a task holds; each block is a pass over the
documents, as the statistics of its terms are.

Scores are sums of whole numbers; they are added as doubles only where every
sum stays below 2^53, else as 64-bit integers.

Defined cases: null, empty and term-free texts count neither in N nor in L and
are never returned; a term-free item (null text included) has no rows; equal
rows of documents are documents of their own, equal rows of items one item;
a null doc_id comes after all others among equal scores; without a document
with terms the result is empty; very long texts are cut into terms whole, in a
task that holds one such text; columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.llm.common import checkpointed, documents, slices

K, BLOCK_BYTES = 20, 4 << 20
#: cells of a block of the count matrix and of the item matrix
_CELLS, _SALTS = 1 << 21, 64
_IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_TERM[b] else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Letters and digits of ASCII and everything beyond, only A-Z lower-cased."""
    return text.translate(_FOLD).split()


# --- bags ---------------------------------------------------------------------------------------------------------------------

def _bags(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            for part in slices(batch, "text"):
                n, bags = [], []
                for x in part.column("text"):
                    count = Counter(terms(x.as_buffer().to_pybytes()) if x.is_valid else ())
                    n.append(sum(count.values()))
                    bag = sorted((vocabulary[t], count[t]) for t in known & count.keys())
                    bags.append(np.array(bag, np.int32).reshape(-1, 2).T.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "_n", "_bag"])

    return run


def _bag(raw: bytes) -> np.ndarray:
    """Term ids and their counts, as two rows."""
    return np.frombuffer(raw, np.int32).reshape(2, -1)


def _statistics(n_terms: int):
    """Per task: documents by term, and under -1 and -2 the documents and the terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n += batch.num_rows
            total += int(batch.column("_n").to_numpy().sum())
            held = [_bag(x.as_buffer())[0] for x in batch.column("_bag")]
            if held:
                df += np.bincount(np.concatenate(held), minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *seen.tolist()], pa.int32()), pa.array([n, total, *df[seen].tolist()], pa.int64())], names=["_t", "_x"])

    return run


# --- scores -------------------------------------------------------------------------------------------------------------------

class Group:
    """Some items: the terms they use and their counts as a matrix."""

    def __init__(self, first: int, bags: list[dict[int, int]], weight: np.ndarray):
        self.first, used = first, np.array(sorted(set().union(*bags)), np.int64)
        self.place = np.full(len(weight), -1, np.int64)
        self.place[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used), len(bags)), np.int64)
        for i, bag in enumerate(bags):
            for t, n in bag.items():
                self.matrix[self.place[t], i] = n
        exact = int((self.matrix * weight[used][:, None]).sum(axis=0).max(initial=0)) * 1_000_000 < 1 << 53
        self.matrix = self.matrix.astype(np.float64) if exact else self.matrix


def grouped(bags: list[dict[int, int]], weight: np.ndarray) -> list[Group]:
    """Items in groups whose matrix has at most about ``_CELLS`` cells (an item with more terms stands alone)."""
    out, start, used = [], 0, set()
    for i, bag in enumerate(bags):
        if i > start and len(used | bag.keys()) * (i + 1 - start) > _CELLS:
            out.append(Group(start, bags[start:i], weight))
            start, used = i, set()
        used |= bag.keys()
    return [*out, Group(start, bags[start:], weight)] if bags else out


class Best:
    """The best ``k`` classes of every item so far: by score, then by least doc_id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held: list[list[tuple]] = [[] for _ in range(items)]

    def add(self, first: int, scores: np.ndarray, names: list[tuple]) -> None:
        rows, items = np.nonzero(scores >= self.least[first:first + scores.shape[1]])
        for r, i, s in zip(rows.tolist(), (items + first).tolist(), scores[rows, items].tolist(), strict=True):
            self.held[i].append((-int(s), *names[r]))
        for i in np.unique(items + first).tolist():
            if len(self.held[i]) > 8 * self.k:
                self.cut(i)

    def cut(self, i: int) -> None:
        self.held[i] = sorted(self.held[i])[:self.k]
        if len(self.held[i]) == self.k:
            self.least[i] = -self.held[i][-1][0]


_SCORES = "_item int, _class bigint, _least bigint, score bigint"


def _score(bags: list[dict[int, int]], weight: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, best = grouped(bags, weight), Best(len(bags), k)
        widest = max(len(g.matrix) for g in groups)
        rows = max(1, min(1024, _CELLS // max(1, widest)))
        for batch in batches:
            for part in (batch.slice(a, rows) for a in range(0, batch.num_rows, rows)):
                held = [_bag(x.as_buffer()) for x in part.column("_bag")]
                row = np.repeat(np.arange(len(held)), [b.shape[1] for b in held])
                t, tf = np.concatenate(held, axis=1).astype(np.int64)
                m = part.column("_m").to_numpy()
                value = weight[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                least = part.column("doc_id").to_pylist()
                names = [(x is None, x or 0, c) for x, c in zip(least, part.column("_class").to_pylist(), strict=True)]
                for g in groups:
                    at = g.place[t]
                    mine = at >= 0
                    counts = np.zeros((len(held), len(g.matrix)), g.matrix.dtype)
                    counts[row[mine], at[mine]] = value[mine]
                    best.add(g.first, (counts @ g.matrix).astype(np.int64), names)
        out = []
        for i in range(len(bags)):
            best.cut(i)
            out += [(i, c, None if none else d, -s) for s, none, d, c in best.held[i]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)],
                                             names=["_item", "_class", "_least", "score"])

    return run


# --- the search ---------------------------------------------------------------------------------------------------------------

def _classes(bags: DataFrame, k: int) -> DataFrame:
    """The ``k`` least doc_ids of every class of identical (bag, m): _class, _place (1: the least, which also holds the bag), doc_id."""
    key = ["_h", "_m", "_bag"]
    order = [F.col("doc_id").asc_nulls_last(), "_row"]
    parts = Window.partitionBy(*key, "_salt").orderBy(*order)
    whole = Window.partitionBy(*key).orderBy(*order)
    few = bags.withColumn("_h", F.xxhash64("_bag", "_m")).withColumn("_salt", F.pmod("_row", F.lit(_SALTS))).withColumn("_p", F.row_number().over(parts)).filter(F.col("_p") <= k)
    few = few.withColumn("_place", F.row_number().over(whole)).withColumn("_class", F.first("_row").over(whole)).filter(F.col("_place") <= k)
    return few.select("_class", "_place", "doc_id", "_row", "_m", F.when(F.col("_place") == 1, F.col("_bag")).alias("_bag"))


def _search_block(docs: DataFrame, items: list[tuple[object, list[bytes]]], k: int) -> DataFrame:
    """Rows (_item, rank, doc_id, score); ``_item`` is a place in ``items``."""
    names = sorted({t for _, found in items for t in found})
    vocabulary = {t: i for i, t in enumerate(names)}
    wanted = [{vocabulary[t]: n for t, n in Counter(found).items()} for _, found in items]
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bags = text.mapInArrow(_bags(vocabulary), "doc_id bigint, _n bigint, _bag binary").filter("_n > 0")
    bags = checkpointed(bags.withColumn("_row", F.monotonically_increasing_id()))
    sums = dict(tuple(r) for r in bags.select("_n", "_bag").mapInArrow(_statistics(len(names)), "_t int, _x bigint").groupBy("_t").agg(F.sum("_x")).collect())
    n, total = sums.get(-1, 0), sums.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sums.get(i, 0) + 1))) for i in range(len(names))], np.int64)
    bags = bags.filter(F.octet_length("_bag") > 0).withColumn("_m", F.expr(f"75 + (25 * _n * {n}L) div {max(total, 1)}L"))
    members = checkpointed(_classes(bags, k))
    firsts = members.filter("_place = 1").select("_class", "doc_id", "_m", "_bag")
    scores = firsts.mapInArrow(_score(wanted, weight, k), _SCORES)
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("_least").asc_nulls_last(), "_class")
    scores = scores.withColumn("_p", F.row_number().over(best)).filter(F.col("_p") <= k)
    ranked = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "_row")
    found = scores.select("_item", "_class", "score").join(members.select("_class", "doc_id", "_row"), "_class")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("_item", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 of every item: item_id, rank, doc_id, score."""
    items = items.select("item_id", "text").filter("text is not null").distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    spark, kind, out = docs.sparkSession, items.schema["item_id"].dataType.simpleString(), None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        held = [(r["item_id"], found) for r in rows if (found := terms(r["text"].encode()))]
        if not held:
            continue
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], f"_item int, item_id {kind}")
        part = _search_block(docs, held, k).join(names, "_item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint") if out is None else out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH items AS (SELECT item_id, text, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item_id, text, term, count(*) AS times FROM items GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
scores AS (
  SELECT item_id, text, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN sized USING (r), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scores JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
