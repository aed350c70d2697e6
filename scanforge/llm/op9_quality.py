"""Quality rules: compression bands.

zstandard ratios (compressed bytes / bytes) of the whole document and of fixed
chunks. Natural prose stays inside a band; repeated text falls below it,
random strings rise above it. The limits depend on length, because a short
text always compresses worse. The plain counts of the contract are computed
beside them, over the whole text.

Defined cases: a null text has no words and fails the base rules; an empty
text likewise; every row gives one row; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import WORD, documents

#: (bytes below, lowest ratio, highest ratio) of a whole document: below the low limit the text repeats itself,
#: above the high limit it is random.
LOW = ((512, 0.25), (1024, 0.22), (4096, 0.20), (16384, 0.18), (1 << 62, 0.15))
#: bytes of an empty frame
FRAME = 9
#: (bytes, highest ratio without the frame), in between by the logarithm of the length: near the high end (99 of 100) of
#: windows of English text of that length, and below random words of letters and digits
HIGH = ((64, 1.00), (80, 0.96), (100, 0.93), (128, 0.89), (160, 0.865), (200, 0.84), (256, 0.815), (320, 0.80), (400, 0.785), (512, 0.755), (640, 0.73),
        (800, 0.69), (1024, 0.66), (1500, 0.62), (2000, 0.59), (3000, 0.57), (4096, 0.56), (8192, 0.54), (16384, 0.52))
#: chunk size in bytes, low limit of a whole chunk, and the share (by bytes) of chunks outside of their limits that rejects a document
CHUNK, CHUNK_LOW, BAD_SHARE = 4096, 0.10, 0.5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, ratio double, bad_chunks double, verdict string")


def repeat_words(words: list[str]) -> int:
    """Words inside an 8-word window that stands twice or more in the text.

    Windows are named exactly: ids of pairs, of pairs of pairs, and so on.
    """
    if len(words) <= WINDOW:
        return 0
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        width *= 2
        if width < WINDOW:
            ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(pair, kind="stable")
    s = pair[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = np.zeros(len(words) + 1, np.int64)
    at = order[twice]
    np.add.at(starts, at, 1)
    np.add.at(starts, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(starts[:-1])))


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


_AT, _TOP = np.log([n for n, _ in HIGH]), [r for _, r in HIGH]


def band(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest ratio, frame included, of a text of that length."""
    low = next(lo for below, lo in LOW if n_bytes < below)
    return low, float(np.interp(np.log(n_bytes), _AT, _TOP)) + FRAME / n_bytes


def bad_share(raw: bytes, z) -> float:
    """Share of the bytes that lie in chunks outside of their limits; the last chunk has those of its own length."""
    bad = 0
    for i in range(0, len(raw), CHUNK):
        chunk = raw[i:i + CHUNK]
        low, high = band(len(chunk))
        if not (CHUNK_LOW if len(chunk) == CHUNK else low) <= len(z.compress(chunk)) / len(chunk) <= high:
            bad += len(chunk)
    return bad / len(raw)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    drop = bytes(set(range(256)) - set(SYMBOLS))
    for batch in batches:
        rows = []
        for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = cell.as_py() or ""
            raw = text.encode()
            words = WORD.findall(text)
            chars = sum(map(len, words))
            repeated = repeat_words(words)
            failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
            ratio, bad, verdict = None, None, "base"
            if raw:
                ratio = len(z.compress(raw)) / len(raw)
                lo, hi = band(len(raw))
                bad = bad_share(raw, z)
                if not failed:
                    verdict = "repetitive" if ratio < lo else "incompressible" if ratio > hi else "chunks" if bad >= BAD_SHARE else "kept"
            rows.append((doc, len(words), chars, len(raw.translate(None, drop)), dup_lines(text), repeated, failed, verdict == "kept", ratio, bad, verdict))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def compression_bands(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, the ratios and the verdict. A single narrow pass."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_measure, _SCHEMA)


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(documents(spark, sf_dir))
