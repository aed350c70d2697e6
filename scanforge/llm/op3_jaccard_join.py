"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document is the set of its 5-word shingles. Each of ``TREES`` trees is a
prefix trie over signatures of ``DEPTH`` minhash values; classes with equal
prefixes of k values meet in a node of depth k.

1. Signatures, one pass. Documents with the same shingle set form one class
   and go on as one row, so copies are never paired.
2. The walk begins at the full depth and halves the prefix until two classes at
   the threshold meet in some tree with the target recall. At each depth only
   nodes whose members are not yet in one component are open: classes that met
   in a longer prefix are not compared again.
3. An open node takes a pivot, the member that meets most others, and its
   members are verified against it on full sets: one row a member. Verified
   edges make components.
4. At the last depth, an open node may hide a link that its pivot did not see.
   Members outside the node's largest component are compared with all members
   of other components, in blocks; signatures choose, full sets confirm.
5. Links are counted inside the components, where all of them lie. A class is
   held as its symmetric difference D with the component's pivot: the
   difference of two classes is that of their D, so small rows decide exactly.
   Distances to the pivot put classes in bands. Jaccard distance is a metric:
   two classes whose distances add up to 1 - threshold at most are linked and
   only counted, two whose distances differ by more are not. The other pairs
   are compared in tiles of two packed blocks of about ``block`` classes.

The exact link counts of a component of m classes take, for what the bands
leave open, work of m * m / 2 set comparisons, in (m / block)^2 / 2 rows; class
ids alone (``count_links=False``) need one row a member and depth.

Defined cases: a document without words (null, empty, white space) has no
shingle and stays alone; under five words the whole text is one shingle;
repeated rows are copies; null doc_ids count as the largest; an empty table
gives an empty result; a long text is handled whole in a task, with some 16
bytes a byte of text; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm import op13_minhash_dedup as stars
from scanforge.llm.common import checkpointed, documents, mix64, slices, text_or_empty, with_text_key
from scanforge.llm.shingles import SLICE, WORDS, components, shingle_sets

THRESHOLD, RECALL = 0.8, 0.9999
TREES, DEPTH, BLOCK = 20, 8, 256
#: share of equal minhash values below which no pair is verified; classes whose links to one pivot a task counts; bytes of differences in a block
LEAST, FAN, BLOCK_BYTES = 0.5, 2000, 1 << 20
#: bands of the distance to the pivot in 1 - threshold
BANDS = 4


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Longest prefix at which a pair at the threshold shares a node of some tree with the target recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def walk(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """Depths visited: the full one, then halved prefixes down to the one that reaches the recall."""
    last, out = prefix_depth(threshold, recall, trees, depth), [depth]
    while out[-1] > last:
        out.append(max(out[-1] // 2, last))
    return out


# --- signatures ---------------------------------------------------------------------------------------------------------------

def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return x[:n] | np.uint64(1), x[n:]


def signatures(sets: list[np.ndarray], trees: int, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per set (none empty): a key for each depth and tree, and the minhash values (16 bits) of the shortest prefixes."""
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    deep, last = max(depths), min(depths)
    a, b = _functions(trees * deep)
    keys, values = np.zeros((len(sets), len(depths), trees), np.uint64), np.zeros((len(sets), trees, last), np.uint16)
    with np.errstate(over="ignore"):
        for t in range(trees):
            prefix = np.full(len(sets), t + 1, np.uint64)
            for k in range(deep):
                lowest = np.minimum.reduceat(flat * a[t * deep + k] + b[t * deep + k], at)
                prefix = mix64(prefix * np.uint64(31) + lowest)
                if k < last:
                    values[:, t, k] = mix64(lowest).astype(np.uint16)
                if k + 1 in depths:
                    keys[:, depths.index(k + 1), t] = prefix
    return keys.view(np.int64), values.reshape(len(sets), -1)


_SIGNED = "doc_id bigint, _th bigint, _c binary, _n int, _sig binary, _keys array<array<bigint>>"


def _sign(words: int, trees: int, depths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets([x.as_buffer().to_pybytes() for x in part.column("text")], words)
                has = [i for i, s in enumerate(sets) if len(s)]
                names, sigs, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if has:
                    made, values = signatures([sets[i] for i in has], trees, depths)
                    for i, k, v in zip(has, made, values, strict=True):
                        names[i], sigs[i], keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), v.tobytes(), list(k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_th"), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                                                  pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "_th", "_c", "_n", "_sig", "_keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets([x.as_buffer().to_pybytes() for x in part.column("text")], words)
                yield pa.RecordBatch.from_arrays([part.column("_c"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_c", "_set"])

    return run


# --- the walk -----------------------------------------------------------------------------------------------------------------

def node_members(classes: DataFrame, level: int) -> DataFrame:
    """(_k, _band, _c, _n, _m): the classes in nodes of several at one depth; ``_band`` is the tree."""
    nodes = classes.select("_c", "_n", F.posexplode(F.col("_keys")[level]).alias("_band", "_k"))
    several = nodes.groupBy("_k").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    return nodes.join(several, "_k")


def open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the nodes that lie in several components."""
    named = members.join(roots, "_c", "left").withColumn("_r", F.coalesce("_root", "_c"))
    several = named.groupBy("_k").agg(F.min("_r").alias("_a"), F.max("_r").alias("_b")).filter("_a <> _b").select("_k")
    return members.join(several, "_k", "left_semi")


def _rooted(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("v").alias("_c"), F.col("root").alias("_root"))


def linked_classes(classes: DataFrame, sets_of, depths: list[int], threshold: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walk the forest: (verified links a, b), (components _c, _root) and the shingle sets of the classes that share a node."""
    percent = round(threshold * 100, 9)
    shallow = checkpointed(node_members(classes, len(depths) - 1))
    sets = checkpointed(sets_of(shallow.select("_c").distinct()))
    links, roots = None, None
    for level in range(len(depths)):
        members = shallow if level == len(depths) - 1 else checkpointed(node_members(classes, level))
        if roots is not None:
            members = checkpointed(open_nodes(members, roots))
        hubs, edges = stars.star_edges(members, percent)
        if roots is not None:  # classes that met in a longer prefix
            one = roots.select(F.col("_c").alias("_hub"), F.col("_root").alias("_r"))
            edges = edges.join(one, "_hub", "left").join(roots, "_c", "left").filter(~F.coalesce(F.col("_r") == F.col("_root"), F.lit(False))).select("_hub", "_c")
        found = checkpointed(stars.confirmed(checkpointed(edges), sets, percent))
        links = found if links is None else links.unionByName(found)
        roots = _rooted(links)

    order, last = ["_k", "_block", F.desc("_out")], depths[-1]
    tiles = stars.open_members(members, hubs, roots, block).join(classes.select("_c", "_n", "_sig"), "_c")
    chosen = checkpointed(tiles.repartition("_k", "_block").sortWithinPartitions(*order).mapInArrow(
        stars._choose(last, LEAST * threshold / THRESHOLD, percent), "_k bigint, _band int, _block int, _out boolean, _c binary, _root binary"))
    if not chosen.isEmpty():
        full = chosen.join(classes.select("_c", "_sig"), "_c").join(sets, "_c")
        more = checkpointed(full.repartition("_k", "_block").sortWithinPartitions(*order).mapInArrow(
            stars._compare(last, LEAST * threshold / THRESHOLD, percent), "a binary, b binary"))
        links = links.unionByName(more)
        roots = _rooted(links)
    return links, roots, sets


# --- link counts --------------------------------------------------------------------------------------------------------------

def _differ(threshold: float):
    """Rows sorted by (_root, _part), the pivot's set first; each class as its symmetric difference with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for root, c, size, s in zip(*(batch.column(k) for k in ("_root", "_c", "_size", "_set")), strict=True):
                if not c.is_valid:
                    own = np.frombuffer(s.as_py(), np.uint64)
                    continue
                x = np.frombuffer(s.as_buffer(), np.uint64)
                delta = np.setxor1d(own, x, assume_unique=True)
                far = len(delta) / ((len(own) + len(x) + len(delta)) / 2)
                out.append((root.as_py(), c.as_py(), size.as_py(), len(x), int(far * BANDS / (1 - threshold)), delta.tobytes()))
            if out:
                types = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names=["_root", "_c", "_size", "_n", "_near", "_delta"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common members of each set on the left with each on the right; only members on both sides are looked at."""
    both = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    if not len(common):
        return both.astype(np.int64)
    where = []
    for values, row in sides:
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        order = np.argsort(at[hit], kind="stable")
        where.append((at[hit][order], row[hit][order]))
    width = 4096
    for k in range(0, len(common), width):
        x = []
        for (at, row), sets in zip(where, (left, right), strict=True):
            a, b = np.searchsorted(at, [k, k + width])
            m = np.zeros((len(sets), min(width, len(common) - k)), np.float32)
            m[row[a:b], at[a:b] - k] = 1
            x.append(m)
        both += x[0] @ x[1].T
    return both.astype(np.int64)


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], n_left: np.ndarray, n_right: np.ndarray, threshold: float) -> np.ndarray:
    """Which classes are linked, from their differences with one pivot and their sizes."""
    apart = np.add.outer([len(x) for x in left], [len(x) for x in right]) - 2 * overlaps(left, right)
    total = np.add.outer(n_left, n_right)
    return total - apart >= threshold * (total + apart) - 1e-9


def _count(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[bytes, int] = {}

        def add(ids: list[bytes], more: np.ndarray) -> None:
            for c, n in zip(ids, more.tolist(), strict=True):
                if n:
                    links[c] = links.get(c, 0) + n  # noqa: B023

        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for name in ("_lo", "_hi"):
                    if (held := batch.column(name)[row]).is_valid:
                        m = held.as_py()
                        sides.append(([x["_c"] for x in m], np.array([x["_size"] for x in m]), np.array([x["_n"] for x in m], np.int64),
                                      [np.frombuffer(x["_delta"], np.uint64) for x in m]))
                (ids, size, n, sets), (ids2, size2, n2, sets2) = sides[0], sides[-1]
                near = near_pairs(sets, sets2, n, n2, threshold)
                if len(sides) == 1:
                    near[np.arange(len(ids)), np.arange(len(ids))] = False
                else:
                    add(ids2, size @ near)
                add(ids, near @ size2)
            if len(links) > 50_000:
                yield _counted(links)
                links = {}
        if links:
            yield _counted(links)

    return run


def _counted(links: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*links], pa.binary()), pa.array([*links.values()], pa.int64())], names=["_c", "_links"])


def count_links(classes: DataFrame, links: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """(_c, _links): the documents of other classes at the threshold or above, for every class of a component."""
    degree = links.select(F.col("a").alias("_c")).unionAll(links.select(F.col("b").alias("_c"))).groupBy("_c").agg(F.count(F.lit(1)).alias("_w"))
    best = degree.join(roots, "_c").groupBy("_root").agg(F.max(F.struct("_w", "_c"))["_c"].alias("_p"), F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("_parts"))
    own = best.join(sets.withColumnRenamed("_c", "_p"), "_p").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = own.select("_root", "_part", F.lit(None).cast("binary").alias("_c"), F.lit(0).cast("bigint").alias("_size"), "_set")
    rest = roots.join(best.select("_root", "_parts"), "_root").withColumn("_part", F.pmod(F.xxhash64("_c"), F.col("_parts")).cast("int"))
    rest = rest.join(classes.select("_c", "_size"), "_c").join(sets, "_c").select("_root", "_part", "_c", "_size", "_set")
    rows = own.unionByName(rest).repartition("_root", "_part").sortWithinPartitions("_root", "_part", F.col("_c").asc_nulls_first())
    members = checkpointed(rows.mapInArrow(_differ(threshold), "_root binary, _c binary, _size bigint, _n int, _near int, _delta binary"))

    # a component of one block stays whole; others are cut by band, and a band into blocks
    weight = [F.count(F.lit(1)).alias("_all"), F.sum(F.length("_delta")).alias("_bytes"), F.sum("_size").alias("_docs")]
    bands = members.groupBy("_root", "_near").agg(*weight)
    fits = (F.sum("_all") <= block) & (F.sum("_bytes") <= BLOCK_BYTES)
    within = [F.sum(F.when(F.col("_near") == b, F.col("_docs")).otherwise(0)).alias(f"_w{b}") for b in range(BANDS - 1)]
    kinds = bands.groupBy("_root").agg(fits.alias("_whole"), *within)
    cut = bands.join(kinds.select("_root", "_whole"), "_root").withColumn("_near", F.when(F.col("_whole"), -1).otherwise(F.col("_near")))
    cut = cut.groupBy("_root", "_near").agg(F.greatest(F.ceil(F.sum("_all") / block), F.ceil(F.sum("_bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("_cuts"))

    placed = members.join(kinds.select("_root", "_whole"), "_root").withColumn("_near", F.when(F.col("_whole"), -1).otherwise(F.col("_near")))
    placed = placed.join(cut, ["_root", "_near"]).withColumn("_cut", F.pmod(F.xxhash64("_c"), F.col("_cuts")).cast("int"))
    packed = checkpointed(placed.groupBy("_root", "_near", "_cut").agg(F.collect_list(F.struct("_c", "_size", "_n", "_delta")).alias("_held")))

    blocks = packed.select("_root", F.struct("_near", "_cut").alias("_x"))
    two = blocks.join(blocks.withColumnRenamed("_x", "_y"), "_root").filter("_x <= _y")
    sure = (F.col("_x._near") >= 0) & (F.col("_x._near") + F.col("_y._near") <= BANDS - 2)
    tiles = two.filter(~sure & (F.col("_y._near") - F.col("_x._near") <= BANDS + 1))  # a band more, for rounding at its edge
    tiles = tiles.withColumn("_y", F.when(F.col("_x") != F.col("_y"), F.col("_y")))
    low = packed.select("_root", F.struct("_near", "_cut").alias("_x"), F.col("_held").alias("_lo"))
    high = packed.select("_root", F.struct("_near", "_cut").alias("_y"), F.col("_held").alias("_hi"))
    counted = tiles.join(low, ["_root", "_x"]).join(high, ["_root", "_y"], "left").select("_lo", "_hi").mapInArrow(_count(threshold), "_c binary, _links bigint")

    sums = [sum((F.col(f"_w{b}") for b in range(BANDS - 1 - near)), F.lit(0)) for near in range(BANDS - 1)]
    known = F.coalesce(*(F.when(F.col("_near") == near, s - (F.col("_size") if 2 * near <= BANDS - 2 else F.lit(0))) for near, s in enumerate(sums)), F.lit(0))
    certain = members.join(kinds.filter("not _whole"), "_root").select("_c", known.cast("bigint").alias("_links"))
    return counted.unionByName(certain).groupBy("_c").agg(F.sum("_links").alias("_links"))


# --- the join -----------------------------------------------------------------------------------------------------------------

def jaccard_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES,
                    block: int = BLOCK, links: bool = True) -> DataFrame:
    """Per document: doc_id, _th, class_id, n_links, n_copies, class_size, first, class_th.

    ``class_id`` is the least doc_id among the documents connected by links,
    ``n_links`` the number of other documents at the threshold or above (copies
    included; left out without ``links``), ``n_copies`` those with the same
    shingle set, itself included, ``first`` marks the document that stands for
    its class, and ``class_th`` is its text hash (a doc_id alone may stand in
    several rows).
    """
    depths = walk(threshold, recall, trees)
    rows = with_text_key(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = checkpointed(rows.select("doc_id", "_th", F.col("text").cast("binary").alias("text")).mapInArrow(_sign(words, trees, depths), _SIGNED))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("_rep")
    kept = [F.first(c).alias(c) for c in ("_n", "_sig", "_keys")]
    classes = checkpointed(signed.filter("_n > 0").groupBy("_c").agg(least, F.count(F.lit(1)).alias("_size"), *kept))

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps = classes.join(wanted, "_c", "left_semi").select("_c", F.col("_rep.doc_id").alias("_d"), F.col("_rep._th").alias("_h"))
        texts = rows.join(reps, rows["doc_id"].eqNullSafe(reps["_d"]) & (rows["_th"] == reps["_h"])).dropDuplicates(["_c"])
        return texts.select("_c", F.col("text").cast("binary").alias("text")).mapInArrow(_sets(words), "_c binary, _set binary")

    edges, roots, sets = linked_classes(classes, sets_of, depths, threshold, block)
    named = classes.select("_c", "_rep", "_size").join(roots, "_c", "left").withColumn("root", F.coalesce("_root", "_c")).drop("_root")
    ids = named.groupBy("root").agg(F.min("_rep").alias("_first"), F.sum("_size").alias("class_size"))
    table = named.join(ids, "root").filter("class_size > 1")
    columns = ["_c", "_first", "class_size", F.col("_size").alias("n_copies")]
    if links:
        table = table.join(count_links(classes, edges, roots, sets, threshold, block), "_c", "left")
        columns.append((F.coalesce("_links", F.lit(0)) + F.col("_size") - 1).alias("n_links"))
    out = signed.select("doc_id", "_th", "_c").join(table.select(*columns), "_c", "left")
    class_id = F.when(F.col("_first").isNull(), F.col("doc_id")).otherwise(F.col("_first.doc_id"))
    first = F.col("_first").isNull() | (F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_th") == F.col("_first._th")))
    class_th = F.coalesce(F.col("_first._th"), F.col("_th")).alias("class_th")
    counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return out.select("doc_id", "_th", class_id.alias("class_id"), *counts, F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
                      F.coalesce("class_size", F.lit(1)).alias("class_size"), first.alias("first"), class_th)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).drop("_th", "first", "class_th")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the first by doc_id; documents without words stay."""
    found = jaccard_classes(docs, links=False).filter("first").groupBy("doc_id", "_th").agg(F.max("n_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("_th", F.xxhash64(text_or_empty()))
    kept = keyed.join(found, keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["_th"] == found["_th"])).select(keyed["*"], "_copies", "_rows")
    repeated = (F.col("_copies") > 1) & (F.col("_rows") > 1)  # the same row several times
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return kept.filter(~repeated).select(columns).unionByName(kept.filter(repeated).dropDuplicates(["doc_id", "_th"]).select(columns))
