"""SentencePiece encoding and decoding by a parallel max-plus scan.

The lattice (op7_lattice) gives the ids of the model's own encoder. Texts are
cut at safe boundaries into segments (words), solved many at a time with numpy
and kept in a bounded cache; a long stretch without a safe boundary is cut into
chunks whose boundary states are joined by transfer matrices.

A giant document (over ``GIANT`` letters) becomes rows of parts, spread over
the tasks. Each part yields the transfer matrix between its boundary states;
the matrices of a document are combined in order; each part is then traced back
on its own from its two states. A part cut at a safe boundary has one state.

Defined cases: null text is empty and has no ids; repeated rows are each
returned; a null doc_id is an id like any other; letters outside the vocabulary
become their bytes; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import documents, slices, with_text_key
from scanforge.llm.op7_lattice import BEGIN, CHUNK, MARK, Chain, Lattice, Matrix, State, combine, entries, load, states_through

#: letters of a document that is split into parts, and of a part
GIANT, PART = 32_768, 16_384
_SNAP, _LONG, _MAX_CACHED, _BATCH = 2048, 2 * CHUNK, 300_000, 1 << 17
_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        self.lattice, self.cache, self.older = load(path), {}, {}

    def marked(self, text: str) -> str:
        return self.lattice.prefix + text.replace(" ", MARK) if text else ""

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        for segments in self._known([self.lattice.segment.findall(self.marked(t)) for t in texts]):
            yield np.frombuffer(b"".join(map(self.cache.__getitem__, segments)), "<i4")

    def segments(self, segments: list[str]) -> list[int]:
        for s in self._known([segments]):
            return np.frombuffer(b"".join(map(self.cache.__getitem__, s)), "<i4").tolist()
        return []

    def _known(self, docs: list[list[str]]) -> list[list[str]]:
        fresh = set().union(*docs).difference(self.cache)
        if len(self.cache) + len(fresh) > _MAX_CACHED and self.cache:  # two generations: what is still in use moves on
            self.cache, self.older = {}, self.cache
            fresh = set().union(*docs)
        if again := fresh & self.older.keys():
            self.cache.update((s, self.older[s]) for s in again)
            fresh -= again
        self._solve([s for s in fresh if len(s) <= _LONG])
        for s in fresh:
            if len(s) > _LONG:
                self.cache[s] = np.array(Chain(self.lattice, s, [BEGIN]).tokens(), "<i4").tobytes()
        return docs

    def _solve(self, segments: list[str]) -> None:
        segments.sort(key=len)
        while segments:
            part, letters = [], 0
            while segments and letters < _BATCH:
                part.append(segments.pop())
                letters += len(part[-1])
            self._solve_part(part)

    def _solve_part(self, part: list[str]) -> None:
        L = self.lattice
        paths = L.paths([(s, len(s), 0, -1) for s in part])
        pos = np.array([len(s) for s in part])
        rows, tokens, live = [], [], np.arange(len(part))
        while len(live):  # all rows walk back together
            t = paths.last[paths.slot[live] + pos[live]]
            rows.append(live)
            tokens.append(t)
            pos[live] -= L.length[t]
            live = live[pos[live] > 0]
        row, token = np.concatenate(rows[::-1]), np.concatenate(tokens[::-1])
        order = np.argsort(row, kind="stable")
        row, token = row[order], token[order].astype("<i4")
        ends = np.searchsorted(row, np.arange(len(part) + 1)) * 4
        data = token.tobytes()
        for s, a, b in zip(part, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            self.cache[s] = data[a:b]
        for k in np.unique(row[token == L.unk]).tolist():
            ids = L.emit(part[k], 0, token[ends[k] // 4:ends[k + 1] // 4].tolist())
            self.cache[part[k]] = np.array(ids, "<i4").tobytes()


def encoder_of(model: str) -> Encoder:
    """One encoder per process, so its cache serves all tasks of a worker."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def decode_ids(lattice: Lattice, ids: np.ndarray) -> str:
    text = b"".join(map(lattice.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if lattice.prefix and text[:1] == " " else text


# --- parts of giant documents -------------------------------------------------------------------------------------------------

def cut(lattice: Lattice, marked: str, part: int = PART, snap: int = _SNAP) -> list[tuple[str, str, str]]:
    """(core, before, after) of every part; before and after are empty at safe boundaries."""
    safe = (lambda i: marked[i] == MARK != marked[i - 1]) if lattice.mark_is_safe else (lambda i: False)
    outside = lambda i: marked[i] not in lattice.letters or marked[i - 1] not in lattice.letters
    cuts, hard = [0], [False]
    while len(marked) - cuts[-1] > part + snap:
        at = cuts[-1] + part
        found = next((i for i in range(at, at + snap) if safe(i) or outside(i)), None)
        cuts.append(found or at)
        hard.append(found is None)
    cuts.append(len(marked))
    hard.append(False)
    w = lattice.width
    out = []
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        before = lattice.segment.findall(marked[max(0, a - w):a])[-1] if hard[k] else ""
        after = lattice.segment.findall(marked[b - 1:b + w])[0][1:] if hard[k + 1] else ""
        out.append((marked[a:b], before, after))
    return out


class Part:
    """A part's segments; only the first and the last can have more than one state at their outer ends."""

    def __init__(self, encoder: Encoder, core: str, before: str, after: str):
        self.encoder, L = encoder, encoder.lattice
        segments = L.segment.findall(core)
        self.first = self.last = None
        if before:
            tail = after if len(segments) == 1 else ""
            self.first = Chain(L, segments[0], entries(L, before, segments[0] + tail), tail)
            segments = segments[1:]
        if after and segments:
            self.last = Chain(L, segments[-1], [BEGIN], after)
            segments = segments[:-1]
        self.middle, self.open = segments, bool(after)

    def matrix(self) -> Matrix:
        out: Matrix = {BEGIN: {BEGIN: 0.0}}
        if self.first:
            out = self.first.matrix()
            if self.last or self.middle or not self.open:  # it ends at a safe boundary
                out = {s: {BEGIN: max(row.values())} for s, row in ((s, {e: v for e, v in r.items() if e[0] == 0}) for s, r in out.items()) if row}
        return combine(out, self.last.matrix()) if self.last else out

    def ids(self, begin: State, end: State) -> list[int]:
        out = []
        if self.first:
            out += self.first.tokens(begin, end if self.open and not self.last and not self.middle else None)
        out += self.encoder.segments(self.middle)
        return out + (self.last.tokens(BEGIN, end) if self.last else [])


_PARTS = "_row string, _copies bigint, _sha string, _part int, core string, before string, after string"


def _cut(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            for row, copies, sha, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                parts = cut(encoder.lattice, encoder.marked(text.as_py()))
                yield pa.RecordBatch.from_pydict({"_row": [row] * len(parts), "_copies": pa.array([copies] * len(parts), pa.int64()), "_sha": [sha] * len(parts),
                                                  "_part": pa.array(range(len(parts)), pa.int32()), **dict(zip(("core", "before", "after"), map(list, zip(*parts, strict=True)), strict=True))})

    return run


def _transfer(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            out = []
            for core, before, after in zip(*(batch.column(x).to_pylist() for x in ("core", "before", "after")), strict=True):
                m = Part(encoder, core, before, after).matrix() if before or after else {BEGIN: {BEGIN: 0.0}}
                out.append(pickle.dumps(m))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_part"), pa.array(out, pa.binary())], names=["_row", "_part", "matrix"])

    return run


def _scan(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("_part")
    states = states_through([pickle.loads(x) for x in frame["matrix"]])
    return pd.DataFrame({"_row": frame["_row"], "_part": frame["_part"], "e0": [s[0] for s in states[:-1]], "t0": [s[1] for s in states[:-1]],
                         "e1": [s[0] for s in states[1:]], "t1": [s[1] for s in states[1:]]})


def _trace(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            out = []
            for core, before, after, e0, t0, e1, t1 in zip(*(batch.column(x).to_pylist() for x in ("core", "before", "after", "e0", "t0", "e1", "t1")), strict=True):
                out.append(np.array(Part(encoder, core, before, after).ids((e0, t0), (e1, t1)), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("_row", "_copies", "_sha", "_part")), pa.array(out, pa.binary())],
                                             names=["_row", "_copies", "_sha", "_part", "ids"])

    return run


# --- results ------------------------------------------------------------------------------------------------------------------

_IDS = "doc_id bigint, n_tokens bigint, n_parts int, ids array<int>"
_DIGEST = "doc_id bigint, n_tokens bigint, n_parts int, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"


def _result(lattice: Lattice, digest: bool, ids: np.ndarray, sha: str) -> tuple:
    if not digest:
        return (ids,)
    back = hashlib.sha256(decode_ids(lattice, ids).encode("utf-8", "surrogatepass")).hexdigest()
    return zlib.crc32(ids.astype("<i4").tobytes()), back, back == sha


def _local(model: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                found = list(encoder.texts(texts))
                size = pa.array([len(x) for x in found], pa.int64())
                head = [part.column("doc_id"), size, pa.array(np.ones(len(found), np.int32))]
                if digest:
                    rows = [_result(encoder.lattice, True, x, hashlib.sha256(t.encode()).hexdigest()) for x, t in zip(found, texts, strict=True)]
                    tail = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)]
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    tail = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(head + tail, names=[x.split()[0] for x in (_DIGEST if digest else _IDS).split(", ")])

    return run


def _assemble(model: str, digest: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_part")
        ids = np.frombuffer(b"".join(frame["ids"]), "<i4")
        row, _, _ = frame["_row"].iat[0].partition(":")
        copies = int(frame["_copies"].iat[0])
        one = (None if row == "null" else int(row), len(ids), len(frame), *_result(load(model), digest, ids, frame["_sha"].iat[0]))
        out = pd.DataFrame([one] * copies, columns=[x.split()[0] for x in (_DIGEST if digest else _IDS).split(", ")])
        return out.astype({"doc_id": "Int64"})

    return run


def row_key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_th").cast("string"))


def encode(docs: DataFrame, model: str, digest: bool = False, giant: int = GIANT) -> DataFrame:
    """doc_id, n_tokens, n_parts and the ids of every document, or their digests."""
    rows = with_text_key(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = _DIGEST if digest else _IDS
    local = rows.filter(F.length("text") <= giant).select("doc_id", "text").mapInArrow(_local(model, digest), schema)
    large = rows.filter(F.length("text") > giant).groupBy(row_key().alias("_row")).agg(F.count(F.lit(1)).alias("_copies"), F.first("text").alias("text"))
    large = large.select("_row", "_copies", F.sha2(F.col("text").cast("binary"), 256).alias("_sha"), "text")
    parts = large.mapInArrow(_cut(model), _PARTS).repartition("_row", "_part")
    matrices = parts.select("_row", "_part", "core", "before", "after").mapInArrow(_transfer(model), "_row string, _part int, matrix binary")
    states = matrices.groupBy("_row").applyInPandas(_scan, "_row string, _part int, e0 int, t0 int, e1 int, t1 int")
    traced = parts.join(states, ["_row", "_part"]).mapInArrow(_trace(model), "_row string, _copies bigint, _sha string, _part int, ids binary")
    return local.unionByName(traced.groupBy("_row").applyInPandas(_assemble(model, digest), schema))


def _decoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = load(model)
        for batch in batches:
            texts = [decode_ids(lattice, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""
    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(_decoded(model), "doc_id bigint, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), model_path(), digest=True)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_parts, ids: one row per row of ``docs``."""
    return encode(docs, model_path())
