"""Repeated passages by a run-length compressed index.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else
too. Documents are bytes; strings never cross documents.

Sharding. Every window of LENGTH bytes has an anchor, the ``GRAM`` bytes in it
whose hash is least (the leftmost of equals). Equal windows have equal anchors
at the same place, so the windows of one anchor can be judged without any
others. Neighbouring windows with the same anchor form a stretch, which is cut
out as one string of its windows and no others.

1. Anchors found once in the whole corpus are dropped. Equal stretches of an
   anchor form one class with a weight; a class of two or more is repeated over
   its full length, and an anchor with one class needs no index. A stretch that
   follows itself (periodic text) is one row with a count.
2. An anchor with more than ``GROUP`` classes (the border of a passage that a
   third of all documents share, say) is split: each class is halved, equal
   halves become one class again, and they regroup by the longer string that
   all their windows share, until the groups are small or a half is one window.
   Nothing is left out.
3. Each task joins groups to a text of about a megabyte and builds its index:
   the Burrows-Wheeler transform as runs, with the text positions of both ends
   of every run and the match lengths there. Inside a run the longest match
   shrinks by one as the position moves on, so streaming over the text from the
   sampled run ends gives the matching statistics of every position against
   the rest. Windows with a match of LENGTH are repeated.
4. The repeated windows go back to all places of their class, are merged per
   document, and are cut out of its text.

Defined cases: null text is empty; a text shorter than LENGTH keeps all bytes;
rows that agree in doc_id and text repeat each other like any two documents;
an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import documents, mix64, slices, with_text_key
from scanforge.session import checkpoint_dir

LENGTH, GRAM, GROUP = 200, 32, 1024
_INDEX_BYTES, _SLICE = 1 << 19, 1 << 19
_BLOCK, _PLACE_BITS = 1 << 23, 24
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/repeats-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _power_tables(n: int) -> list[np.ndarray]:
    global _powers
    if not _powers or len(_powers[0]) < n:
        _powers = []
        for base in (_BASE, _INVERSE):
            x = np.full(max(n, 2 * _SLICE), base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


class Hashes:
    """Hashes of any substring of some bytes."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
            return mix64(x + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --- anchors ------------------------------------------------------------------------------------------------------------------

def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, content, text number, first window, windows, place of the anchor, times) of the texts that end at ``ends`` in ``data``.

    ``times`` counts a stretch that stands that often one right behind the other.
    """
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return (none,) * 7
    hashes = Hashes(data)
    with np.errstate(over="ignore"):
        h = mix64((hashes.sums[gram:] - hashes.sums[:-gram]) * hashes.inverse[:n - gram + 1])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:-(width - span)], least[width - span:])
    at = (least & low).astype(np.int64)  # the anchor of each window
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int32)  # windows that end inside their text
    some = ends - starts >= length
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:len(at)]) > 0)
    if not len(windows):
        return (none,) * 7
    anchor = at[windows]
    text = np.searchsorted(ends, windows, "right")
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(windows)]]))
    begin, text = windows[first], text[first]
    content, gram_hash = hashes.of(begin, begin + count + length - 1), h[anchor[first]]
    same = (gram_hash[1:] == gram_hash[:-1]) & (content[1:] == content[:-1]) & (text[1:] == text[:-1]) & (count[1:] == count[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    times = np.diff(np.concatenate([head, [len(first)]]))
    out = (gram_hash.view(np.int64), content.view(np.int64), text, begin - starts[text], count, anchor[first] - begin)
    return (*(x[head] for x in out), times)


_PLACES = "_a bigint, _x bigint, doc_id bigint, _th bigint, _p bigint, _n int, _o int, _r int"


def _blocks(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in blocks that share LENGTH - 1 bytes, so that every window lies in exactly one."""
    for at in range(0, max(1, len(raw) - LENGTH + 1), _BLOCK):
        yield at, raw[at:at + _BLOCK + LENGTH - 1]


def _find(only_anchor: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                rows, shift, texts, held = [], [], [], 0
                for i, x in enumerate(part.column("text")):
                    for at, block in _blocks(x.as_buffer().to_pybytes()):
                        if held + len(block) > _BLOCK + LENGTH:
                            yield found(part, rows, shift, texts)
                            rows, shift, texts, held = [], [], [], 0
                        rows.append(i)
                        shift.append(at)
                        texts.append(block)
                        held += len(block)
                if rows:
                    yield found(part, rows, shift, texts)

    def found(part: pa.RecordBatch, rows: list[int], shift: list[int], texts: list[bytes]) -> pa.RecordBatch:
        a, x, text, p, n, o, times = stretches(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
        if only_anchor:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(times.astype(np.int32))], names=["_a", "_r"])
        row = pa.array(np.array(rows, np.int64)[text])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(x), part.column("doc_id").take(row), part.column("_th").take(row),
                                           pa.array(p + np.array(shift, np.int64)[text]), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32)),
                                           pa.array(times.astype(np.int32))],
                                          names=["_a", "_x", "doc_id", "_th", "_p", "_n", "_o", "_r"])

    return run


# --- classes and their bytes --------------------------------------------------------------------------------------------------

# a class: the bytes of some windows; _key names its group and _tag its bytes, _w counts its places; the anchor stands at _o of the bytes,
# and the windows start _c0 to _c1 - 1 bytes before the anchor
_CLASSES = "_key bigint, _tag bigint, _w bigint, _hot boolean, _bytes binary, _o int, _c0 int, _c1 int"
# a half of a class (_pk, _pt), from its window _lo on
_HALVES = "_pk bigint, _pt bigint, _lo int, _key bigint, _tag bigint, _w bigint, _bytes binary, _o int, _c0 int, _c1 int"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            rows = []
            for text, wanted in zip(part.column("text"), part.column("_wanted"), strict=True):
                raw = text.as_buffer()
                rows += [(w["_a"], w["_x"], w["_w"], w["_hot"], raw.slice(w["_p"], w["_n"] + LENGTH - 1).to_pybytes(), w["_o"], 0,
                          LENGTH - GRAM + 1) for w in wanted.as_py()]
            if rows:
                yield _batch(_CLASSES, rows)


def halves(data: bytes, o: int, c0: int, c1: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, cell) of both halves of a cell.

    Cells are counted from the anchor, so equal windows are always in equal cells.
    """
    n, mid = len(data) - LENGTH + 1, (c0 + c1) // 2
    for a, b in ((c0, mid), (mid, c1)):
        i, j = max(0, o - b + 1), min(n - 1, o - a)
        if a < b and i <= j:
            yield i, j, a, b


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(parts), digest_size=8).digest(), "big", signed=True)


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, tag, w, data, o, c0, c1 in zip(*(batch.column(c).to_pylist() for c in ("_key", "_tag", "_w", "_bytes", "_o", "_c0", "_c1")), strict=True):
            for i, j, left, right in halves(data, o, c0, c1):
                shared, part = data[o - left:o - right + 1 + LENGTH], data[i:j + LENGTH]
                rows.append((key, tag, i, _hash(b"%d %d" % (left, right), shared), _hash(part), w, part, o - i, left, right))
        if rows:
            yield _batch(_HALVES, rows)


# --- the index ----------------------------------------------------------------------------------------------------------------

class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, with sampled run ends.

    Every string ends in a mark of its own, smaller than any byte and ordered
    like the strings.
    """

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.ends = np.cumsum(size)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        n = self.n = len(self.data)
        self.starts = self.ends - size
        self.left = np.repeat(self.ends, size) - np.arange(n)  # bytes up to the end of the string
        rows = self._sorted()
        before = self.data[np.maximum(rows - 1, 0)].astype(np.int32)
        first = np.zeros(n, bool)
        first[self.starts[size > 0]] = True
        before[first[rows]] = -1 - rows[first[rows]]  # the mark before a string's first byte: unlike any other
        turn = before[1:] != before[:-1]
        head, tail = np.flatnonzero(turn) + 1, np.flatnonzero(turn)
        #: run lengths and letters; text positions at both ends of the runs, with the matches there
        self.letters = before[np.concatenate([[0], head])]
        self.lengths = np.diff(np.concatenate([[0], head, [n]]))
        lcp = self._matches(rows[tail], rows[head])
        self.head_at, self.head_match = rows[head], lcp
        self.tail_at, self.tail_match = rows[tail], lcp
        self.edge_at = rows[[0, -1]]

    def _packed(self, per: int) -> np.ndarray:
        """The next ``per`` letters from every position as one number, nothing after the string's end."""
        out = np.zeros(self.n, np.uint64)
        for j in range(per):
            out <<= np.uint64(9)
            inside = self.left > j
            out[inside] |= self.data[np.flatnonzero(inside) + j].astype(np.uint64) + np.uint64(1)
        return out

    def _sorted(self) -> np.ndarray:
        """Suffix array, by doubling; only suffixes still tied are sorted again."""
        n, h = self.n, 7
        key = self._packed(h)
        rows = np.argsort(key, kind="stable")
        s = key[rows]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        rank = np.empty(n, np.int64)
        rank[rows] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1  # place of the first of its group
        longest = int(self.left.max(initial=0))
        while h < longest:
            alone = new & np.concatenate([new[1:], [True]])
            tied = np.flatnonzero(~alone)
            # groups that end before h letters are equal for good and stay in text order
            tied = tied[self.left[rows[tied]] >= h]
            if not len(tied):
                break
            r = rows[tied]
            second = np.where(self.left[r] > h, rank[r + np.minimum(h, self.left[r] - 1)], 0)
            group = rank[r]
            order = np.lexsort((second, group))
            r, second, group = r[order], second[order], group[order]
            rows[tied] = r
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
            new[tied] = fresh
            rank[r] = np.maximum.accumulate(np.where(fresh, tied, 0)) + 1
            h *= 2
        return rows

    def _matches(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at a and b, eight bytes at a time."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        word = np.lib.stride_tricks.as_strided(padded, (self.n + 1, 8), (1, 1)).copy().view("<u8").ravel()
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            diff = word[a[live] + out[live]] ^ word[b[live] + out[live]]
            same = np.where(diff == 0, 8, np.zeros(len(live), np.int64))
            odd = np.flatnonzero(diff)
            if len(odd):
                bit = diff[odd] & (~diff[odd] + np.uint64(1))
                same[odd] = np.log2(bit.astype(np.float64)).astype(np.int64) // 8
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every position with any other one, streamed from the run ends."""
        best = np.zeros(self.n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            # first and last row have no neighbour on one side: a match of nothing
            edge = self.edge_at[0 if at is self.head_at else 1]
            reach = np.full(self.n, -1, np.int64)
            reach[at] = at + match
            reach[edge] = edge
            sampled = np.where(reach >= 0, np.arange(self.n), 0)
            last = np.maximum.accumulate(sampled)
            best = np.maximum(best, reach[last] - np.arange(self.n))
        return np.minimum(np.maximum(best, 0), self.left)


def repeated_windows(strings: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each string the runs (first, last) of its windows that stand twice or more among the strings."""
    index = RunLengthIndex(strings)
    found = index.matching_statistics() >= length
    out = []
    for start, end, w in zip(index.starts.tolist(), index.ends.tolist(), weights, strict=True):
        n = max(0, end - start - length + 1)
        hit = np.ones(n, bool) if w > 1 else found[start:start + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        runs = edge.reshape(-1, 2)
        runs[:, 1] -= 1
        out.append(runs)
    return out


_FOUND = "_key bigint, _tag bigint, _runs array<int>"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of classes sorted by key; whole groups are joined until a text is long enough."""

    def solve() -> pa.RecordBatch | None:
        found = repeated_windows([h[3] for h in held], [h[2] for h in held])
        rows = [(h[0], h[1], runs.ravel()) for h, runs in zip(held, found, strict=True) if len(runs)]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["_key", "_tag", "_runs"])

    held, n, current = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("_key", "_tag", "_w", "_bytes")), strict=True):
            if row[0] != current and n > _INDEX_BYTES:
                if (out := solve()) is not None:
                    yield out
                held, n = [], 0
            current = row[0]
            held.append(row)
            n += len(row[3])
    if held and (out := solve()) is not None:
        yield out


# --- the operator -------------------------------------------------------------------------------------------------------------

def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, _spans): the repeated windows of every document that has some, as (first byte, runs) per stretch."""
    rows = with_text_key(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "_th", F.col("text").cast("binary").alias("text"))
    long = rows.filter(F.octet_length("text") >= LENGTH)
    often = long.mapInArrow(_find(True), "_a bigint, _r int").groupBy("_a").agg(F.sum("_r").alias("_n_a")).filter("_n_a > 1").select("_a")
    places = stored(long.mapInArrow(_find(False), _PLACES).join(often, "_a"))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th", "_p", "_n", "_o")).alias("_rep")
    classes = places.groupBy("_a", "_x").agg(F.sum("_r").alias("_w"), first)
    groups = classes.groupBy("_a").agg(F.count(F.lit(1)).alias("_d"))
    classes = stored(classes.join(groups, "_a"))
    alone = classes.filter("_d = 1").select(F.col("_a").alias("_key"), F.col("_x").alias("_tag"), F.array(F.lit(0), F.col("_rep._n") - 1).alias("_runs"))
    wanted = classes.filter("_d > 1").select(F.col("_rep.doc_id").alias("_doc"), F.col("_rep._th").alias("_h"), F.struct(
        "_a", "_x", "_w", (F.col("_d") > GROUP).alias("_hot"), F.col("_rep._p").alias("_p"), F.col("_rep._n").alias("_n"), F.col("_rep._o").alias("_o")).alias("_one"))
    wanted = wanted.groupBy("_doc", "_h").agg(F.collect_list("_one").alias("_wanted"))
    cut = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_doc"]) & (rows["_th"] == wanted["_h"])).select("text", "_wanted").mapInArrow(_cut, _CLASSES)

    level, ready, halvings = stored(cut), [], []
    while True:
        ready.append(level.filter("not _hot").select("_key", "_tag", "_w", "_bytes"))
        hot = level.filter("_hot")
        if hot.isEmpty():
            break
        parts = stored(hot.mapInArrow(_halve, _HALVES))
        halvings.append(parts.select("_pk", "_pt", "_lo", "_key", "_tag"))
        merged_parts = parts.groupBy("_key", "_tag").agg(F.sum("_w").alias("_w"), *[F.first(c).alias(c) for c in ("_bytes", "_o", "_c0", "_c1")])
        groups = merged_parts.groupBy("_key").agg(F.count(F.lit(1)).alias("_d"))
        level = merged_parts.join(groups, "_key").filter((F.col("_d") > 1) | (F.col("_w") > 1))  # the rest stands alone
        level = level.withColumn("_hot", (F.col("_d") > GROUP) & (F.col("_c1") - F.col("_c0") > 1))
        level = stored(level.select("_key", "_tag", "_w", "_hot", "_bytes", "_o", "_c0", "_c1"))
    indexed = ready[0]
    for x in ready[1:]:
        indexed = indexed.unionByName(x)
    found = indexed.repartition("_key").sortWithinPartitions("_key").mapInArrow(_index, _FOUND)
    found = stored(found) if halvings else found
    for parts in reversed(halvings):  # from the halves back to their classes
        shifted = F.transform("_runs", lambda x: x + F.col("_lo"))
        whole = parts.join(found, ["_key", "_tag"]).groupBy("_pk", "_pt").agg(F.flatten(F.collect_list(shifted)).alias("_runs"))
        found = found.unionByName(whole.withColumnsRenamed({"_pk": "_key", "_pt": "_tag"}))
    found = found.unionByName(alone).withColumnsRenamed({"_key": "_a", "_tag": "_x"})
    runs = F.when(F.col("_r") > 1, F.array(F.lit(0), F.col("_r") * F.col("_n") - 1)).otherwise(F.col("_runs"))
    return places.join(found, ["_a", "_x"]).groupBy("doc_id", "_th").agg(F.collect_list(F.struct("_p", runs.alias("_runs"))).alias("_spans"))


def merged(spans: list, length: int = LENGTH) -> np.ndarray:
    """Byte ranges (begin, end) covered by windows, touching ones joined."""
    runs = np.concatenate([np.asarray(s["_runs"], np.int64).reshape(-1, 2) + s["_p"] for s in spans])
    runs[:, 1] += length
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > reach[:-1]])
    return np.stack([runs[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(runs) - 1]])]], axis=1)


def _remove(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            total, gone, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("_spans"), strict=True):
                raw = text.as_buffer().to_pybytes()
                cuts = merged(found.as_py()) if found.is_valid else np.zeros((0, 2), np.int64)
                rest = b"".join(raw[a:b] for a, b in zip([0, *cuts[:, 1].tolist()], [*cuts[:, 0].tolist(), len(raw)], strict=True))
                total.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans.append(len(cuts))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (total, gone, spans)),
                                              pa.array(kept, pa.string() if digest else pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay (or their SHA-256)."""
    spans = repeated_spans(docs)
    rows = with_text_key(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "_th", F.col("text").cast("binary").alias("text"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["_th"] == spans["_th"]), "left").select(rows["doc_id"], "text", "_spans")
    return joined.mapInArrow(_remove(digest), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "kept binary"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digest=True)
