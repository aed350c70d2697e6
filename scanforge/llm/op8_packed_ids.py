"""Token ids as fixed-width bit-packed files.

A file holds the ids of a run of documents, in ascending doc_id, as blocks of
``BLOCK_IDS`` ids of ``bits`` bits each (the fewest that hold the vocabulary),
most significant bit first. Behind the blocks stand the byte offset of every
block, the documents (doc_id, number of ids) and a fixed-size trailer, so a
reader can unpack any block, or any range of ids, with numpy and without the
blocks before it.

Documents are range-partitioned by doc_id; each task encodes its run and writes
one file into a shared folder, under a name of its own attempt, and returns a
manifest row. The manifest is checkpointed, so files are written once; a lost
executor's attempt leaves a file that no manifest row names.

Encoding goes word by word: the tokenizer of the contract drops white space and
never joins across it, so a text's ids are its words' ids one after another. A
bounded cache keeps words already encoded.

Defined cases: null text is empty; a document without ids holds the end id
only; a null doc_id comes first; repeated rows each get their entry; an empty
table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.llm.common import checkpointed, documents, with_text_key
from scanforge.session import checkpoint_dir

END_ID, BLOCK_IDS, MAX_CACHED, MAX_CORES = 2, 1 << 16, 500_000, 500_000
MARKS = b".,;:!?"
_MAGIC, _TRAILER = b"PKID1\0\0\0", struct.Struct("<8sQQQQIB3x")
_NO_ID = -(1 << 63)
_encoders: dict[str, WordEncoder] = {}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits per id, most significant first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits:]).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits:] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class PackedWriter:
    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.at = 0
        self.offsets, self.docs, self.sizes = [0], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(_NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            data = pack(ids[i:min(i + self.block_ids, whole)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held = [ids[whole:].copy()] if whole < len(ids) else []
        self.n_held = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes())
        self.out.write(np.array(self.sizes, "<u8").tobytes())
        self.out.write(_TRAILER.pack(_MAGIC, self.at, len(self.offsets) - 1, len(self.docs), self.n_ids, self.block_ids, self.bits))


class PackedReader:
    """Random access to a packed file through a seekable handle."""

    def __init__(self, handle):
        self.f = handle
        size = handle.size()
        magic, at, blocks, docs, self.n_ids, self.block_ids, self.bits = _TRAILER.unpack(self._read(size - _TRAILER.size, _TRAILER.size))
        if magic != _MAGIC:
            raise ValueError("not a packed id file")
        index = self._read(at, 8 * (blocks + 1 + 2 * docs))
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        self.sizes = np.frombuffer(index, "<u8", docs, 8 * (blocks + 1 + docs)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        data = self._read(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack(data[self.offsets[k] - self.offsets[a]:self.offsets[k + 1] - self.offsets[a]], self.bits, int(n)))
        return np.concatenate(out)[start - a * self.block_ids:stop - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def plain_core(letters: bytes) -> bytes | None:
    """Lower case of a word of Latin letters only; None for any other."""
    text = letters.decode()
    return text.lower().encode() if text.isalpha() and max(text) < "\u0100" else None


class WordEncoder:
    """Ids of a text, as little-endian uint32 bytes, through a cache of words.

    A word of Latin letters with marks behind it is encoded as its lower-case
    letters and its marks, which the tokenizer keeps apart, so the forms of a
    word share one entry.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        #: tokens that end a word; empty if the model doesn't mark word ends
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:  # else words are encoded one by one
            self.final[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.cache: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        split, other = [], []
        for w in words:
            letters = w.rstrip(MARKS)
            core = letters.lower() if letters.isalpha() else plain_core(letters)
            if core is None:
                other.append(w)
            else:
                split.append((w, core, w[len(letters):]))
        cores, marks = {x[1] for x in split}, {x[2] for x in split}
        if len(self.cores) + len(cores) > MAX_CORES:
            self.cores.clear()
        known, cache = self.cores, self.cache
        self._learn_cores(list(cores.difference(known)))
        self._learn_each(list(marks.difference(known)), known)
        self._learn_each(other, cache)
        for w, core, rest in split:
            cache[w] = known[core] + known[rest] if rest else known[core]

    def _learn_cores(self, cores: list[bytes]) -> None:
        parts = [cores[i:i + 1000] for i in range(0, len(cores), 1000)]
        found = self.tokenizer.encode_batch_fast([b"\n".join(p).decode() for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(part) and len(ids) == ends[-1]:  # one last token a word
                data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
                self.cores.update(zip(part, [data[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
            else:
                self._learn_each(part, self.cores)

    def _learn_each(self, words: list[bytes], into: dict) -> None:
        for i in range(0, len(words), 8192):
            part = words[i:i + 8192]
            e = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1))
            data = ids.tobytes()
            for w, a, b in zip(part, (ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist(), strict=True):
                into[w] = data[a:b]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for t in texts:
            held.append(t.split())
            n += len(held[-1])
            if n > 200_000:
                yield from self._known(held)
                held, n = [], 0
        yield from self._known(held)

    def _known(self, docs: list[list[bytes]]) -> Iterator[np.ndarray]:
        fresh = set().union(*docs).difference(self.cache) if docs else set()
        if fresh:
            if len(self.cache) + len(fresh) > MAX_CACHED:
                self.cache.clear()
                fresh = set().union(*docs)
            self.learn(fresh)
        get = self.cache.__getitem__
        for words in docs:
            yield np.frombuffer(b"".join(map(get, words)), "<u4")


def encoder_of(path: str) -> WordEncoder:
    """One encoder per process, so its cache serves all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        writer, out, encoder = None, None, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_of(tokenizer)
                out = store.open_output_stream(path)
                writer = PackedWriter(out, encoder.bits)
            texts = [x.as_buffer().to_pybytes() for x in batch.column("text")]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                writer.add(doc, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([len(writer.docs)], pa.int64()),
                                              pa.array([writer.n_ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    return run


def _uri(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def write_packed(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write every document; returns the manifest (part, path, n_docs, n_ids, start), files in ascending doc_id."""
    from pyarrow import fs

    folder = _uri(folder)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = with_text_key(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "_th", F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id", "_th").sortWithinPartitions("doc_id", "_th").select("doc_id", "text")
    manifest = checkpointed(ordered.mapInArrow(_write(folder, tokenizer, end_id), "part bigint, path string, n_docs bigint, n_ids bigint"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _digest(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    r = PackedReader(f)
                    i = 0
                    while i < len(r.docs):
                        j = max(i + 1, int(np.searchsorted(r.starts, r.starts[i] + (1 << 20), "right")) - 1)
                        data = r.ids(int(r.starts[i]), int(r.starts[j])).astype("<u4").tobytes()
                        at = (r.starts[i:j + 1] - r.starts[i]) * 4
                        crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        docs = r.docs[i:j]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, pa.int64(), mask=docs == _NO_ID), pa.array(r.starts[i:j] + start, pa.int64()), pa.array(r.sizes[i:j], pa.int64()),
                             pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    return run


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = manifest.select("path", "start", "part")
    files = rows.repartitionByRange(max(1, rows.count()), "part").select("path", "start")  # a named number: tiny rows that stand for files aren't folded
    return files.mapInArrow(_digest(_uri(folder)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{checkpoint_dir(spark)}/packed-ids-{uuid.uuid4().hex}"
    manifest = write_packed(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(manifest, folder)
