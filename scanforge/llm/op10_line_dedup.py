"""Line dedup: range-partitioned line hashes, sorted by document and position.

Each document becomes rows (line hash, document, positions). They are
partitioned by *range* of (hash, document) and sorted inside the partitions,
so a line that stands in a third of all documents spreads over many
partitions. One streaming pass over each partition decides every hash; what a
partition cannot decide alone (a run cut off at its first or last row) is left
open, and settled from the runs at the borders. The pass returns positions, never
text; they become one zlib-compressed keep bitmap per document.

The query counts documents, as its contract says. The pipeline's stage counts a
line once per class of copies and near copies (the classes of the Jaccard join,
whose stage comes next and keeps one of each), so a text with many copies does
not take its own lines for boilerplate.

Defined cases: a null or empty text is one empty line; an empty key is never
dropped; rows that agree in doc_id and text are one document; a null doc_id is
an id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import WS, checkpointed, documents, same_row, with_text_key
from scanforge.llm.op3_jaccard_join import jaccard_classes

MIN_DOCS = 10
#: _cd and _ct name the class that a document counts for
_LINES = "_h binary, _cd bigint, _ct bigint, doc_id bigint, _th bigint, _pos array<int>"
_ORDER = ["_h", "_cd", "_ct", "doc_id", "_th"]
_MARKS = "_kind int, " + _LINES
_MARK, _OPEN, _COUNT = 0, 1, 2
#: undecided rows of one hash held in memory; more are left open
_HELD = 10_000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, of, positions = [], [], []
        for i, text in enumerate(batch.column("text")):
            at: dict[bytes, list[int]] = {}
            for p, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                key = line.strip(WS).lower()
                if key:
                    at.setdefault(key, []).append(p)
            hashes += [hashlib.blake2b(k, digest_size=16).digest() for k in at]
            positions += at.values()
            of += [i] * len(at)
        rows = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *(batch.column(c).take(rows) for c in _ORDER[1:]), pa.array(positions, pa.list_(pa.int32()))],
                                         names=[*_ORDER, "_pos"])


def _frequent(min_docs: int, most: int = _HELD):
    """One pass over sorted rows: marks of hashes found in ``min_docs`` classes, open rows, and the classes of hashes with open rows."""

    def emit(kind: int, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                          names=["_kind", *_ORDER, "_pos"])

    types = [pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, border = None, None, True
        classes: list[tuple] = []
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for h, cd, ct, d, t, p in zip(*(batch.column(c).to_pylist() for c in _ORDER), batch.column("_pos"), strict=True):
                if h != current:
                    if border and current is not None:
                        yield emit(_COUNT, [(current, *c, None, None, None) for c in classes])
                        if held:
                            yield emit(_OPEN, held)
                    border, current, last, classes, held = current is None, h, None, [], []
                if (d, t) == last:
                    continue  # the same document once more
                last = (d, t)
                if len(classes) < min_docs and (not classes or classes[-1] != (cd, ct)):
                    classes.append((cd, ct))
                if len(classes) < min_docs:
                    held.append((h, cd, ct, d, t, p.as_py()))
                    if len(held) >= most:  # a large class: left open
                        yield emit(_OPEN, held)
                        held, border = [], True
                else:
                    out += held
                    held = []
                    out.append((h, cd, ct, d, t, p.as_py()))
            if len(out) > 20_000:
                yield emit(_MARK, out)
                out = []
        if out:
            yield emit(_MARK, out)
        if current is not None:
            yield emit(_COUNT, [(current, *c, None, None, None) for c in classes])
            if held:
                yield emit(_OPEN, held)

    return run


def copy_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, _cd, _ct) of every document that has copies or near copies: the class is named by its first document."""
    found = jaccard_classes(docs, links=False).filter("class_size > 1")
    return found.select("doc_id", "_th", F.col("class_id").alias("_cd"), F.col("class_th").alias("_ct")).distinct()


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, _th, bitmap) of every document that loses a line.

    A line goes if it stands in ``min_docs`` documents, or in documents of
    ``min_docs`` different ``classes`` (doc_id, _th, _cd, _ct; a document
    without one is its own class). ``bitmap`` is zlib over ``numpy.packbits``
    of one keep bit per line, up to the last dropped line; lines after it stay.
    """
    keyed = with_text_key(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "_th", F.col("text").cast("binary").alias("text"))
    if classes is None:
        keyed = keyed.withColumn("_cd", F.col("doc_id")).withColumn("_ct", F.col("_th"))
    else:
        own = F.col("_ct").isNull()
        keyed = keyed.join(classes, same_row(keyed, classes), "left").select(
            keyed["doc_id"], keyed["_th"], "text", F.when(own, keyed["doc_id"]).otherwise(F.col("_cd")).alias("_cd"), F.coalesce("_ct", keyed["_th"]).alias("_ct"))
    lines = keyed.mapInArrow(_keys, _LINES)
    ordered = lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    found = checkpointed(ordered.mapInArrow(_frequent(min_docs), _MARKS))
    counted = found.filter(F.col("_kind") == _COUNT).select("_h", "_cd", "_ct").distinct()
    totals = counted.groupBy("_h").agg(F.count(F.lit(1)).alias("_total")).filter(F.col("_total") >= min_docs)
    settled = found.filter(F.col("_kind") == _OPEN).join(totals, "_h", "left_semi")
    marks = found.filter(F.col("_kind") == _MARK).select("doc_id", "_th", "_pos").unionByName(settled.select("doc_id", "_th", "_pos"))
    dropped = marks.groupBy("doc_id", "_th").agg(F.array_sort(F.flatten(F.collect_list("_pos"))).alias("dropped"))
    return dropped.mapInArrow(_bitmaps, "doc_id bigint, _th bigint, bitmap binary")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for p in batch.column(2):
            at = p.values.to_numpy(zero_copy_only=False)
            keep = np.ones((int(at[-1]) // 8 + 1) * 8, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "_th", "bitmap"])


def _apply(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """Kept text, number of lines, number of dropped lines."""
    if bitmap is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    gone = np.flatnonzero(keep == 0)
    for i in gone:
        lines[i] = None
    return b"\n".join(x for x in lines if x is not None), len(lines), len(gone)


def _applied(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, total, gone = [], [], []
            for text, bitmap in zip(batch.column("text"), batch.column("bitmap").to_pylist(), strict=True):
                kept, n, d = _apply(text.as_buffer().to_pybytes(), bitmap)
                results.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                total.append(n)
                gone.append(d)
            rest = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "bitmap")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in rest] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(results, pa.string())],
                names=[batch.schema.names[i] for i in rest] + ["n_lines", "n_dropped", "kept_sha256" if digest else "text"])

    return run


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text without its frequent lines); with ``digest``, kept_sha256 in place of the text."""
    maps = keep_bitmaps(docs, min_docs)
    base = with_text_key(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    joined = base.join(maps, same_row(base, maps), "left").select(base["doc_id"], base["text"].cast("binary").alias("text"), "bitmap")
    return joined.mapInArrow(_applied(digest), "doc_id bigint, n_lines bigint, n_dropped bigint, " + ("kept_sha256 string" if digest else "text string"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_frequent_lines(documents(spark, sf_dir), digest=True)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ``MIN_DOCS`` copy classes; n_chars follows the text. A document left without any word goes."""
    maps = keep_bitmaps(docs, classes=copy_classes(docs))
    base = docs.select("doc_id", text_or_null(docs), "lang", "source").withColumn("_th", F.xxhash64("text"))
    joined = base.join(maps, same_row(base, maps), "left").select(base["doc_id"], "lang", "source", base["text"].cast("binary").alias("text"), "bitmap")
    out = joined.mapInArrow(_applied(False), "doc_id bigint, lang string, source string, n_lines bigint, n_dropped bigint, text string")
    kept = out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def text_or_null(docs: DataFrame):
    return F.coalesce(docs["text"], F.lit("")).alias("text")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
