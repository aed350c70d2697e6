"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates.

A document is the set of its 2-word shingles, only A-Z lower-cased.

1. One hash a shingle (one permutation): its top bits choose a bin, the least
   hash of a bin is its value. An empty bin takes the value of the first filled
   bin in a fixed random order of its own (optimal densification). Documents
   with the same set form one class and go on as one row.
2. ``ROWS`` neighbouring bins are a band and give a bucket key. Two classes with
   Jaccard similarity 0.8 miss each other in all bands with probability 5e-8.
3. A bucket of m classes gives a star: m - 1 candidate edges to its hub, the
   class that meets most others in its buckets. Near copies of one text share
   their hub in most buckets, so the distinct edges stay about as many as the
   classes. Edges are verified on the full sets, a hub's edges in parts.
4. Verified edges make components. A bucket whose other members lie in several
   components may hide a link that its hub did not see: there, every member
   outside the largest component is compared with all members of others.
   That runs in blocks of ``BLOCK`` such outsiders, against which the members are
   streamed; signatures choose, full sets confirm, and an outsider gives one
   link a component. Nothing is capped.
5. Components of all links by label propagation, each round checkpointed.

Defined cases: null, empty and word-free texts have no shingle, are linked with
nothing and stay; a single word is one shingle; rows with equal texts are
copies; null doc_ids count as the largest, and a component of null doc_ids
alone has a null component_id (its rows are kept); an empty table gives an
empty result; a long text is handled whole in a task, with some 16 bytes a byte
of text; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import checkpointed, documents, mix64, slices, with_text_key
from scanforge.llm.shingles import components, shingle_sets

WORDS, PERCENT, BANDS, ROWS = 2, 80, 32, 4
#: outsiders of a bucket compared at once; edges of a hub verified in one go; estimated similarity below which no pair is verified
BLOCK, FAN, LEAST = 256, 2000, 0.6
_SLICE = 1 << 19


def _sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    return shingle_sets([x.as_buffer().to_pybytes().lower() for x in texts], words)


# --- signatures ---------------------------------------------------------------------------------------------------------------

def orders(bins: int) -> np.ndarray:
    """For every bin a random order of all bins, the bin itself first."""
    noise = mix64(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bins, bins)
    noise[np.arange(bins), np.arange(bins)] = 0
    return np.argsort(noise, axis=1)


def signatures(sets: list[np.ndarray], bins: int, order: np.ndarray) -> np.ndarray:
    """One row of ``bins`` values a set (sorted, distinct, none empty); ``bins`` is a power of two."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = row * bins + (flat >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted: the least hash of a bin comes first
    values, filled = np.zeros(len(sets) * bins, np.uint64), np.zeros(len(sets) * bins, bool)
    values[cell[first]], filled[cell[first]] = flat[first], True
    empty = np.flatnonzero(~filled)
    source, open_ = np.zeros(len(empty), np.int64), np.arange(len(empty))
    for t in range(1, bins):
        if not len(open_):
            break
        at = empty[open_]
        take = at - at % bins + order[at % bins, t]
        hit = filled[take]
        source[open_[hit]] = take[hit]
        open_ = open_[~hit]
    values[empty] = values[source]
    return mix64(values).reshape(len(sets), bins)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    keys = np.zeros((len(values), values.shape[1] // rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = mix64(keys * np.uint64(31) + values[:, k::rows])
        return mix64(keys + np.arange(1, keys.shape[1] + 1, dtype=np.uint64)).view(np.int64)


_SIGNED = "doc_id bigint, _th bigint, _c binary, _n int, _sig binary, _keys array<bigint>"


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = orders(bands * rows)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                sets = _sets_of(part.column("text"), words)
                has = [i for i, s in enumerate(sets) if len(s)]
                names, sigs, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if has:
                    values = signatures([sets[i] for i in has], bands * rows, order)
                    for i, v, k in zip(has, values.astype(np.uint16), band_keys(values, rows), strict=True):
                        names[i], sigs[i], keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), v.tobytes(), k
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_th"), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                                                  pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "_th", "_c", "_n", "_sig", "_keys"])

    return run


def _class_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                yield pa.RecordBatch.from_arrays([part.column("_c"), pa.array([s.tobytes() for s in _sets_of(part.column("text"), words)], pa.binary())], names=["_c", "_set"])

    return run


# --- stars --------------------------------------------------------------------------------------------------------------------

def star_edges(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(_k, _hub) for every bucket of ``members`` (_k, _c, _n, _m), and the distinct edges (_hub, _c) that sizes allow."""
    weight = members.groupBy("_c").agg(F.sum("_m").alias("_w"))
    best = members.join(weight, "_c").groupBy("_k").agg(F.max(F.struct("_w", "_c", "_n")).alias("_best"))
    hubs = best.select("_k", F.col("_best._c").alias("_hub"), F.col("_best._n").alias("_hn"))
    fits = F.least("_n", "_hn").cast("bigint") * 100 >= F.greatest("_n", "_hn").cast("bigint") * percent
    edges = members.join(hubs, "_k").filter(fits & (F.col("_c") != F.col("_hub"))).select("_hub", "_c").distinct()
    return hubs.select("_k", "_hub"), edges


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Members of the sorted set ``b`` in the sorted set ``a``."""
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = shared(a, b) if len(a) >= len(b) else shared(b, a)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """Rows sorted by (_hub, _part), the hub's own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            out = []
            for h, c, s in zip(*(batch.column(k) for k in ("_hub", "_c", "_set")), strict=True):
                if not c.is_valid:
                    hub, own = h.as_py(), np.frombuffer(s.as_py(), np.uint64)
                elif near(own, np.frombuffer(s.as_buffer(), np.uint64), percent):
                    out.append((hub, c.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are near; a hub's set goes to each part of its edges once."""
    hubs = edges.groupBy("_hub").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("_parts"))
    own = hubs.join(sets.withColumnRenamed("_c", "_hub"), "_hub").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = own.select("_hub", "_part", F.lit(None).cast("binary").alias("_c"), "_set")
    rest = edges.join(hubs, "_hub").withColumn("_part", F.pmod(F.xxhash64("_c"), F.col("_parts")).cast("int")).join(sets, "_c")
    rows = own.unionByName(rest.select("_hub", "_part", "_c", "_set"))
    return rows.repartition("_hub", "_part").sortWithinPartitions("_hub", "_part", F.col("_c").asc_nulls_first()).mapInArrow(_confirm(percent), "a binary, b binary")


# --- what a hub does not see --------------------------------------------------------------------------------------------------

def open_members(members: DataFrame, hubs: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """Members to compare: _k, _block, _out (an outsider, to be compared with all others of its block), _c, _root."""
    named = members.join(roots, "_c", "left").withColumn("_root", F.coalesce("_root", "_c")).select("_k", "_band", "_c", "_root")
    named = named.join(hubs, "_k").filter(F.col("_c") != F.col("_hub")).drop("_hub")
    sizes = named.groupBy("_k", "_root").agg(F.count(F.lit(1)).alias("_s"))
    buckets = sizes.groupBy("_k").agg(F.max(F.struct("_s", "_root")).alias("_major"), F.sum("_s").alias("_all")).filter("_all > _major._s")
    buckets = buckets.select("_k", F.col("_major._root").alias("_major"), F.ceil((F.col("_all") - F.col("_major._s")) / block).cast("int").alias("_blocks"))
    rows = named.join(buckets, "_k").withColumn("_own", F.when(F.col("_root") != F.col("_major"), F.pmod(F.xxhash64("_c"), F.col("_blocks")).cast("int")))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("_k", "_band", "_block", F.coalesce(F.col("_own") == F.col("_block"), F.lit(False)).alias("_out"), "_c", "_root")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], Iterator[dict]]]:
    """(outsiders, all other rows streamed) of each block; rows are sorted by (_k, _block), outsiders first."""
    rows = ({c: x for c, x in zip(b.schema.names, r, strict=True)} for b in batches for r in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True))
    row = next(rows, None)
    while row is not None:
        key, outsiders = (row["_k"], row["_block"]), []
        while row is not None and (row["_k"], row["_block"]) == key and row["_out"]:
            outsiders.append(row)
            row = next(rows, None)

        def others() -> Iterator[dict]:
            nonlocal row
            while row is not None and (row["_k"], row["_block"]) == key:  # noqa: B023
                yield row
                row = next(rows, None)

        rest = others()
        yield outsiders, rest
        for _ in rest:
            pass


def _similar(x: np.ndarray, all_x: np.ndarray, band: int, rows: int, least: float) -> np.ndarray:
    """Which of the signatures may be near ``x``, if ``band`` is the first band that both share."""
    equal = all_x == x
    bands = equal.reshape(len(all_x), -1, rows).all(axis=2)
    return (equal.mean(axis=1) >= least) & ~bands[:, :band].any(axis=1)


def _choose(rows_in_band: int, least: float, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        names = ["_k", "_band", "_block", "_out", "_c", "_root"]
        held: list[tuple] = []
        for outsiders, others in _blocks(batches):
            if not outsiders:
                continue
            sigs, sizes = np.array([np.frombuffer(o["_sig"], np.uint16) for o in outsiders]), np.array([o["_n"] for o in outsiders])
            roots = np.array([o["_root"] for o in outsiders], dtype=object)
            wanted = np.zeros(len(outsiders), bool)

            def partners(m: dict, upto: int) -> np.ndarray:
                if not upto:
                    return np.zeros(0, bool)
                found = _similar(np.frombuffer(m["_sig"], np.uint16), sigs[:upto], m["_band"], rows_in_band, least)  # noqa: B023
                found &= (roots[:upto] != m["_root"]) & (100 * np.minimum(sizes[:upto], m["_n"]) >= percent * np.maximum(sizes[:upto], m["_n"]))  # noqa: B023
                return found

            for i, o in enumerate(outsiders):
                if (found := partners(o, i)).any():
                    wanted[:i] |= found
                    wanted[i] = True
            for m in others:
                if (found := partners(m, len(outsiders))).any():
                    wanted |= found
                    held.append(tuple(m[c] for c in names))
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held = []
            held += [tuple(outsiders[i][c] for c in names) for i in np.flatnonzero(wanted).tolist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return run


def _compare(rows_in_band: int, least: float, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outsiders, others in _blocks(batches):
            sigs, sets = [np.frombuffer(o["_sig"], np.uint16) for o in outsiders], [np.frombuffer(o["_set"], np.uint64) for o in outsiders]
            done: list[set] = [set() for _ in outsiders]
            found = []

            def against(m: dict, upto: int) -> None:
                if not upto:
                    return
                own = np.frombuffer(m["_set"], np.uint64)
                similar = _similar(np.frombuffer(m["_sig"], np.uint16), np.array(sigs[:upto]), m["_band"], rows_in_band, least)  # noqa: B023
                for i in np.flatnonzero(similar).tolist():
                    if m["_root"] != outsiders[i]["_root"] and m["_root"] not in done[i] and near(sets[i], own, percent):  # noqa: B023
                        done[i].add(m["_root"])  # noqa: B023
                        found.append((outsiders[i]["_c"], m["_c"]))  # noqa: B023

            for i, o in enumerate(outsiders):
                against(o, i)
            for m in others:
                against(m, len(outsiders))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


# --- the operator -------------------------------------------------------------------------------------------------------------

def near_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links lead to), kept."""
    least = max(0.0, percent / 100 - (1 - LEAST / (PERCENT / 100)))
    text = with_text_key(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = checkpointed(text.select("doc_id", "_th", F.col("text").cast("binary").alias("text")).mapInArrow(_sign(words, bands, rows), _SIGNED))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("_rep")
    classes = checkpointed(signed.filter("_n > 0").groupBy("_c").agg(first, F.first("_n").alias("_n"), F.first("_sig").alias("_sig"), F.first("_keys").alias("_keys")))

    dealt = classes.select("_c", "_n", F.posexplode("_keys").alias("_band", "_k"))
    several = dealt.groupBy("_k").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    members = checkpointed(dealt.join(several, "_k"))
    hubs, edges = star_edges(members, percent)
    hubs, edges = checkpointed(hubs), checkpointed(edges)

    wanted = members.select("_c").distinct().join(classes, "_c").select("_c", F.col("_rep.doc_id").alias("_d"), F.col("_rep._th").alias("_h"))
    found = text.join(wanted, text["doc_id"].eqNullSafe(wanted["_d"]) & (text["_th"] == wanted["_h"])).dropDuplicates(["_c"])
    sets = checkpointed(found.select("_c", F.col("text").cast("binary").alias("text")).mapInArrow(_class_sets(words), "_c binary, _set binary"))
    links = checkpointed(confirmed(edges, sets, percent))

    roots = components(links).select(F.col("v").alias("_c"), F.col("root").alias("_root"))
    order = ["_k", "_block", F.desc("_out")]
    tiles = open_members(members, hubs, roots, block).join(classes.select("_c", "_n", "_sig"), "_c")
    chosen = checkpointed(tiles.repartition("_k", "_block").sortWithinPartitions(*order).mapInArrow(
        _choose(rows, least, percent), "_k bigint, _band int, _block int, _out boolean, _c binary, _root binary"))
    if not chosen.isEmpty():
        full = chosen.join(classes.select("_c", "_sig"), "_c").join(sets, "_c")
        more = checkpointed(full.repartition("_k", "_block").sortWithinPartitions(*order).mapInArrow(_compare(rows, least, percent), "a binary, b binary"))
        roots = components(links.unionByName(more)).select(F.col("v").alias("_c"), F.col("root").alias("_root"))

    named = classes.select("_c", "_rep").join(roots, "_c", "left").withColumn("_root", F.coalesce("_root", "_c"))
    ids = named.groupBy("_root").agg(F.min("_rep").alias("_least"))
    table = named.join(ids, "_root").select("_c", F.col("_least.doc_id").alias("_id"))
    out = signed.select("doc_id", "_n", "_c").join(table, "_c", "left")
    component = F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("_id"))
    return out.select("doc_id", F.col("_n").cast("bigint").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
