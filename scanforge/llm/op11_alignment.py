"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes (a space and the text): A, a byte-level BPE,
and B, a SentencePiece model that puts the space in front itself. Byte offsets
where tokens of both end cut a document into groups; an A and a B token are
linked where their byte ranges overlap.

1. Texts are encoded in slices (a longer text in slices of its own). The two
   sorted lists of token ends of a slice are to be merged; binary searches on
   the merge path's diagonals, all at once, cut that work into pieces of equal
   length that need nothing of each other but one token on either side. Pieces
   become rows, written to the shared folder.
2. Each piece is merged on its own: every distinct end closes one overlap, so
   it gives one link; an end of both closes a group. Pieces give the counts of
   their id pairs, which are summed over the corpus; the highest count of a B
   id is found from the sums.
3. The sums of a piece's own id pairs go to the piece, which gives its documents'
   figures and groups.
4. Parts of a document are put together in order. A group that is open at a
   piece's end goes on in the next one. The digest is fed part by part.

Encoding cuts texts where neither tokenizer can join across: in front of a
space or line feed between two characters that are no white space. The parts
are encoded once and kept in a bounded table. Vocabularies for which that is
not safe are encoded a text at a time. tiktoken runs A's merges where they
stand in the order of ids and the part holds only old Latin letters (Unicode
versions of the two libraries' patterns may differ beyond); else tokenizers.

Defined cases: null and empty texts, and texts that either tokenizer does not
give back byte by byte, have no tokens: zeros and an empty digest; every row
is a document, also where rows or ids repeat or doc_id is null; an empty table
gives an empty result; texts of any length are handled in slices, but one that
cannot be cut is encoded in one call; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import checkpointed, documents, slices

#: steps of the merge in a piece, letters in a slice, remembered parts of texts
WORK, SLICE, _KNOWN = 1 << 20, 1 << 22, 600_000
#: fixed values: the split pattern of byte-level BPE
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SEGMENT = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S+)*(?:\s+\Z)?|\s+")
_OLD_LATIN = re.compile(r"[\x00-ɏ]*\Z")
_WHOLE = re.compile(r"(?s).+")


# --- tokenizers ---------------------------------------------------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A; ``safe`` tells whether texts may be cut between words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = _byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.bytes_of = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        how = spec["pre_tokenizer"] or {}
        self.safe = spec["normalizer"] is None and how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space")
        merges = [m if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        made = [vocabulary[m.replace(" ", "")] for m in merges]
        self.fast = None
        if self.safe and made == sorted(made) and not spec["model"].get("ignore_merges"):
            import tiktoken
            ranks = {b: i for i, b in enumerate(self.bytes_of) if b and i not in special.values()}
            if len(ranks) == 256 + len(made):
                self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and _OLD_LATIN.match(t) is not None for t in texts]
        rest = iter(self.library.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]


class Pieces:
    """Tokenizer B on texts that begin with the space it adds itself."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, self.mark = model.normalizer_spec, self.library.piece_to_id("▁")
        self.safe = (norm.add_dummy_prefix and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and self.library.encode("\nx")[:1] == [self.mark]
                     and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """``texts`` begin with a space, or with a line feed inside a text: then the added mark is taken off."""
        found = self.library.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, found, strict=True)]


class Both:
    """Both tokenizers with a bounded table of the parts of texts seen most."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.segment = _SEGMENT if self.a.safe and self.b.safe else _WHOLE
        self.kinds = [np.dtype("<u2" if len(t.bytes_of) <= 1 << 16 else "<u4") for t in (self.a, self.b)]
        self.length = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b)]
        self.names = np.array([f"{i}{end}" for end in ",|;" for i in range(max(map(len, self.length)))], dtype=object)
        self._start()

    def _start(self) -> None:
        self.place: dict[str, int] = {}
        self.uses, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = [np.zeros(0, k) for k in self.kinds]
        self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def _keep(self, names: list[str], good: np.ndarray, ids: list[np.ndarray], size: list[np.ndarray], uses: np.ndarray) -> None:
        self.place |= zip(names, range(len(self.place), len(self.place) + len(names)), strict=True)
        self.good, self.uses = np.concatenate([self.good, good]), np.concatenate([self.uses, uses])
        self.ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]
        self.size = [np.concatenate(x) for x in zip(self.size, size, strict=True)]
        self.start = [np.cumsum(s) - s for s in self.size]

    def _forget(self) -> None:
        """The half of the table that was used most stays."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[:_KNOWN // 2])
        names, old = list(self.place), (self.good[stay], [self.take(k, stay) for k in (0, 1)], [s[stay] for s in self.size], self.uses[stay] // 2)
        self._start()
        self._keep([names[i] for i in stay.tolist()], *old)

    def _learn(self, names: list[str]) -> None:
        found = [self.a.encode(names), self.b.encode(names)]
        size = [np.array([len(x) for x in f], np.int64) for f in found]
        flat = [np.fromiter(chain.from_iterable(f), k, int(n.sum())) for f, k, n in zip(found, self.kinds, size, strict=True)]
        self._keep(names, self._given_back(names, flat, size), flat, size, np.zeros(len(names), np.int64))

    def _given_back(self, names: list[str], flat: list[np.ndarray], size: list[np.ndarray]) -> np.ndarray:
        """Which texts both tokenizers give back byte by byte."""
        raw = [n.encode() for n in names]
        end = np.cumsum([len(r) for r in raw])
        good = np.ones(len(raw), bool)
        for t, ids, n, length in zip((self.a, self.b), flat, size, self.length, strict=True):
            upto = np.concatenate([[0], np.cumsum(length[ids])])[np.cumsum(n)]
            back = b"".join(map(t.bytes_of.__getitem__, ids.tolist()))
            if back != b"".join(raw) or (upto != end).any():  # one by one
                good &= [back[x:y] == r for r, x, y in zip(raw, [0, *upto[:-1].tolist()], upto.tolist(), strict=True)]
        return good

    def _places(self, segments: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, segments, repeat(-1)), np.int64, len(segments))

    def find(self, segments: list[str]) -> np.ndarray:
        at = self._places(segments)
        if (at < 0).any():
            new = dict.fromkeys(segments[i] for i in np.flatnonzero(at < 0).tolist())
            if self.place and len(self.place) + len(new) > _KNOWN:
                self._forget()
                at = self._places(segments)
                new = dict.fromkeys(segments[i] for i in np.flatnonzero(at < 0).tolist())
            self._learn(list(new))
            missing = np.flatnonzero(at < 0)
            at[missing] = self._places([segments[i] for i in missing.tolist()])
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at

    def known_good(self, segments: list[str]) -> bool:
        at = self.find(segments)
        return bool(self.good[at].all())

    def take(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ids of A (0) or B (1) of the parts ``at``, one after the other."""
        size = self.size[k][at]
        return self.ids[k][np.repeat(self.start[k][at] - np.cumsum(size) + size, size) + np.arange(size.sum())]


@functools.lru_cache(2)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


# --- pieces of equal work -----------------------------------------------------------------------------------------------------

def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` steps that merge the sorted ``a`` and ``b`` (equal values: a first) take from ``a``."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        late = np.zeros(len(at), bool)
        late[open_] = b[(at - mid - 1)[open_]] < a[mid[open_]]
        high, low = np.where(open_ & late, mid, high), np.where(open_ & ~late, mid + 1, low)
    return low


_PIECE = ("_piece bigint, _keys array<bigint>, _ids array<bigint>, _a_upto array<int>, _b_upto array<int>, _begun boolean, _open boolean, "
          "_a binary, _b binary, _a_from bigint, _b_from bigint, _a_next int, _b_next int")
_PIECE_TYPES = pa.schema([("_piece", pa.int64()), ("_keys", pa.list_(pa.int64())), ("_ids", pa.list_(pa.int64())), ("_a_upto", pa.list_(pa.int32())),
                          ("_b_upto", pa.list_(pa.int32())), ("_begun", pa.bool_()), ("_open", pa.bool_()), ("_a", pa.binary()), ("_b", pa.binary()),
                          ("_a_from", pa.int64()), ("_b_from", pa.int64()), ("_a_next", pa.int32()), ("_b_next", pa.int32())])


def cut_pieces(enc: Both, keys: list[int], ids: list, tokens: list[tuple[np.ndarray, np.ndarray]], begun: bool, goes_on: bool, work: int) -> Iterator[dict]:
    """Rows for the documents of a slice, each with its A and B ids; the first may have begun, the last may go on, in another slice."""
    flat = [np.concatenate([t[k] for t in tokens]) for k in (0, 1)]
    upto = [np.concatenate([[0], np.cumsum([len(t[k]) for t in tokens])]) for k in (0, 1)]
    ends = [np.cumsum(enc.length[k][flat[k]]) for k in (0, 1)]
    steps = upto[0] + upto[1]
    n = max(1, -(-int(steps[-1]) // work))
    cut = np.arange(n + 1) * int(steps[-1]) // n
    a_cut = diagonals(*ends, cut)
    b_cut = cut - a_cut
    first = np.minimum(np.searchsorted(cut, steps[:-1], "right") - 1, n - 1)
    last = np.maximum(first, np.searchsorted(cut, steps[1:], "left") - 1)
    squeeze = zstandard.ZstdCompressor(level=6).compress
    for p in range(n):
        (a0, a1), (b0, b1) = a_cut[p:p + 2].tolist(), b_cut[p:p + 2].tolist()
        d0, d1 = int(np.searchsorted(last, p, "left")), int(np.searchsorted(first, p, "right"))
        came = [int(ends[k][x - 1]) if x else 0 for k, x in ((0, a0), (1, b0))]
        yield {"_keys": keys[d0:d1], "_ids": ids[d0:d1], "_a_upto": (np.clip(upto[0][d0 + 1:d1 + 1], a0, a1) - a0).tolist(), "_b_upto": (np.clip(upto[1][d0 + 1:d1 + 1], b0, b1) - b0).tolist(),
               "_begun": bool(steps[d0] < cut[p]) or begun and d0 == 0, "_open": bool(steps[d1] > cut[p + 1]) or goes_on and d1 == len(keys) and p == n - 1,
               "_a": squeeze(flat[0][a0:a1].tobytes()), "_b": squeeze(flat[1][b0:b1].tobytes()), "_a_from": came[0] - min(came), "_b_from": came[1] - min(came),
               "_a_next": int(flat[0][a1]) if a1 < len(flat[0]) else 0, "_b_next": int(flat[1][b1]) if b1 < len(flat[1]) else 0}


def _in_parts(enc: Both, text: str, size: int) -> Iterator[list[str]]:
    held, letters = [], 0
    for m in enc.segment.finditer(text):
        held.append(m[0])
        letters += len(m[0])
        if letters >= size:
            yield held
            held, letters = [], 0
    if held:
        yield held


def _slice_rows(enc: Both, docs: list[tuple[int, int | None, str]], size: int, work: int) -> Iterator[dict]:
    nothing = tuple(np.zeros(0, k) for k in enc.kinds)
    if len(docs) == 1 and len(docs[0][2]) > size:
        key, name, text = docs[0]
        if not all(enc.known_good(part) for part in _in_parts(enc, " " + text, size)):
            yield from cut_pieces(enc, [key], [name], [nothing], False, False, work)
            return
        parts, begun = _in_parts(enc, " " + text, size), False
        part = next(parts)
        while part:
            after = next(parts, None)
            at = enc.find(part)
            yield from cut_pieces(enc, [key], [name], [(enc.take(0, at), enc.take(1, at))], begun, after is not None, work)
            part, begun = after, True
        return
    segments = [enc.segment.findall(" " + text) if text else [] for _, _, text in docs]
    at = enc.find([s for x in segments for s in x])
    row = np.repeat(np.arange(len(docs)), [len(x) for x in segments])
    bad = np.zeros(len(docs), bool)
    bad[row[~enc.good[at]]] = True
    at, row = at[~bad[row]], row[~bad[row]]
    cut = [np.cumsum(np.bincount(row, enc.size[k][at], len(docs)).astype(np.int64))[:-1] for k in (0, 1)]
    tokens = list(zip(*(np.split(enc.take(k, at), cut[k]) for k in (0, 1)), strict=True))
    yield from cut_pieces(enc, [d[0] for d in docs], [d[1] for d in docs], tokens, False, False, work)


def _encode(path_a: str, path_b: str, size: int, work: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = both(path_a, path_b)
        base, key, piece = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in slices(batch, "text", size):
                docs = [(base + key + i, d, t or "") for i, (d, t) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True))]
                key += len(docs)
                for row in _slice_rows(enc, docs, size, work):
                    yield pa.RecordBatch.from_pylist([row | {"_piece": base + piece}], _PIECE_TYPES)
                    piece += 1

    return run


# --- merging a piece ----------------------------------------------------------------------------------------------------------

class Merged:
    """A piece's links, in two runs: one at each A end, one at each B end that is no A end; and its cuts."""

    def __init__(self, enc: Both, row: dict):
        unpack = zstandard.ZstdDecompressor().decompress
        self.a, self.b = (np.frombuffer(unpack(row[c]), k).astype(np.int64) for c, k in zip(("_a", "_b"), enc.kinds, strict=True))
        a_end, b_end = (start + np.cumsum(n[x]) for start, n, x in zip((row["_a_from"], row["_b_from"]), enc.length, (self.a, self.b), strict=True))
        a_all, b_all = np.append(self.a, row["_a_next"]), np.append(self.b, row["_b_next"])
        done = np.searchsorted(a_end, b_end, "right")  # A ends up to each B end
        same = np.concatenate([[row["_a_from"]], a_end])[done] == b_end
        self.cut_b = np.flatnonzero(same)  # B tokens that end a group, and the A tokens up to there
        self.cut_a = done[self.cut_b]
        self.alone = np.flatnonzero(~same)
        self.pairs = np.concatenate([b_all[np.searchsorted(b_end, a_end, "left")] << 32 | self.a, self.b[self.alone] << 32 | a_all[done[self.alone]]])
        self.a_upto, self.b_upto = np.array(row["_a_upto"], np.int64), np.array(row["_b_upto"], np.int64)
        self.alone_upto, self.cut_upto = np.searchsorted(self.alone, self.b_upto), np.searchsorted(self.cut_b, self.b_upto)

    def per_document(self, value: np.ndarray) -> np.ndarray:
        """Sum of a value of the links by document."""
        total = np.concatenate([[0], np.cumsum(value)])
        upto = total[self.a_upto] + total[len(self.a) + self.alone_upto] - total[len(self.a)]
        return np.diff(upto, prepend=0)

    def words(self, enc: Both) -> np.ndarray:
        """The ids as decimal words with what follows each, groups in order, in a group A before B."""
        v = len(enc.names) // 3
        group_a, group_b = np.searchsorted(self.cut_a, np.arange(len(self.a)), "right"), np.searchsorted(self.cut_b, np.arange(len(self.b)), "left")
        b_before, a_before = np.concatenate([[0], self.cut_b + 1]), np.concatenate([self.cut_a, [len(self.a)]])
        a_word, b_word = self.a.copy(), self.b.copy()
        a_word[self.cut_a[self.cut_a > 0] - 1] += v
        b_word[self.cut_b] += 2 * v
        out = np.zeros(len(a_word) + len(b_word), np.int64)
        out[np.arange(len(a_word)) + b_before[group_a]] = a_word
        out[np.arange(len(b_word)) + a_before[group_b]] = b_word
        return enc.names[out]


def _count(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = both(path_a, path_b)
        for batch in batches:
            for row in _rows(batch):
                pair, n = np.unique(Merged(enc, row).pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row["_piece"])), pa.array(pair), pa.array(n.astype(np.int64))], names=["_piece", "_pair", "_n"])

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


# --- figures and groups of documents ------------------------------------------------------------------------------------------

_PART = ("_key bigint, _piece bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
         "_whole boolean, _digest string, _cuts boolean, _first_a string, _first_b string, _closed string, _last_a string, _last_b string")
_PART_NAMES = [c.split()[0] for c in _PART.split(", ")]
_PART_TYPES = pa.schema([(c.split()[0], {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.large_string()}[c.split()[1]]) for c in _PART.split(", ")])


def _parts(enc: Both, row: dict, pair: np.ndarray, total: np.ndarray, best: np.ndarray, keep: bool) -> Iterator[list]:
    """A row for each document of a piece; ``_whole``: it lies in this piece, has its digest here and, if they are kept, its groups in ``_closed``."""
    m = Merged(enc, row)
    at = np.searchsorted(pair, m.pairs)
    figures = [m.per_document(x).tolist() for x in (np.ones(len(at), np.int64), best[at].astype(np.int64), total[at])]
    words = m.words(enc)
    a, b, c = [0, *m.a_upto.tolist()], [0, *m.b_upto.tolist()], [0, *m.cut_upto.tolist()]
    cut_a, cut_b, docs = m.cut_a.tolist(), m.cut_b.tolist(), len(row["_keys"])
    for d in range(docs):
        whole = not (d == 0 and row["_begun"]) and not (d == docs - 1 and row["_open"])
        n_cuts = c[d + 1] - c[d]
        groups, digest = [None] * 5, None
        if whole:
            text = "".join(words[a[d] + b[d]:a[d + 1] + b[d + 1]].tolist())[:-1]
            digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
            groups[2] = text if keep else None
        else:
            comma = enc.names[:len(enc.names) // 3]
            listed = lambda ids: "".join(comma[ids].tolist())[:-1]  # noqa: E731, B023
            if n_cuts:
                (a0, b0), (a1, b1) = ((cut_a[k], cut_b[k] + 1) for k in (c[d], c[d + 1] - 1))
                groups = [listed(m.a[a[d]:a0]), listed(m.b[b[d]:b0]), "".join(words[a0 + b0:a1 + b1].tolist())[:-1], listed(m.a[a1:a[d + 1]]), listed(m.b[b1:b[d + 1]])]
            else:
                groups = [None, None, None, listed(m.a[a[d]:a[d + 1]]), listed(m.b[b[d]:b[d + 1]])]
        yield [row["_keys"][d], row["_piece"], row["_ids"][d], a[d + 1] - a[d], b[d + 1] - b[d], n_cuts, *(x[d] for x in figures), whole, digest, n_cuts > 0, *groups]


def _figures(path_a: str, path_b: str, keep: bool):
    """Pieces with ``_own``, the sums of their id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = both(path_a, path_b)
        for batch in batches:
            own = batch.column("_own")
            for i, row in enumerate(_rows(batch.drop_columns(["_own"]))):
                known = own.slice(i, 1).flatten().flatten()
                pair, total, best = (x.to_numpy(zero_copy_only=False) for x in known)
                order = np.argsort(pair)
                parts = list(_parts(enc, row, pair[order], total[order], best[order], keep))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), _PART_TYPES.types, strict=True)], schema=_PART_TYPES)

    return run


class Stitched:
    """Parts of one document in order; open groups go on in the next part."""

    def __init__(self, part: list, keep: bool):
        self.doc_id, self.sums, self.digest, self.kept = part[2], [0] * 6, hashlib.sha256(), [] if keep else None
        self.ready = part[10]
        self.a: list[str] = []
        self.b: list[str] = []
        self.any = False
        self.add(part)

    def write(self, text: str) -> None:
        text = ";" * self.any + text
        self.any = True
        self.digest.update(text.encode())
        if self.kept is not None:
            self.kept.append(text)

    def add(self, part: list) -> None:
        self.sums = [x + y for x, y in zip(self.sums, part[3:9], strict=True)]
        whole, _, cuts, first_a, first_b, closed, last_a, last_b = part[9:]
        if cuts and not whole:
            self.write(",".join(filter(None, [*self.a, first_a])) + "|" + ",".join(filter(None, [*self.b, first_b])))
            self.a, self.b = [], []
        if closed:
            self.write(closed)
        if not whole:
            self.a.append(last_a)
            self.b.append(last_b)

    def row(self) -> list:
        return [self.doc_id, *self.sums, self.ready if self.ready is not None else self.digest.hexdigest() if self.any else "", "".join(self.kept) if self.kept is not None else None]


_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"


def _stitch(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [c.split()[0] for c in _OUT.split(", ")], [pa.int64()] * 7 + [pa.string()] * 2
        key, doc = None, None
        for batch in batches:
            out = []
            for part in zip(*(batch.column(c).to_pylist() for c in _PART_NAMES), strict=True):
                if doc is not None and part[0] == key:
                    doc.add(part)
                    continue
                if doc is not None:
                    out.append(doc.row())
                key, doc = part[0], Stitched(part, keep)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(doc.row(), types, strict=True)], names=names)

    return run


# --- the alignment ------------------------------------------------------------------------------------------------------------

def pieces(docs: DataFrame, path_a: str, path_b: str, size: int = SLICE, work: int = WORK) -> DataFrame:
    """Equal pieces of merging, written to the shared folder, so that a piece's name keeps its contents."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return checkpointed(text.mapInArrow(_encode(path_a, path_b, size, work), _PIECE))


def pair_counts(cut: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Links of every id pair by piece: _piece, _pair (B id above, A id below 32 bits), _n."""
    return cut.drop("_keys", "_ids").mapInArrow(_count(path_a, path_b), "_piece bigint, _pair bigint, _n bigint")


def align(docs: DataFrame, path_a: str, path_b: str, size: int = SLICE, work: int = WORK, with_groups: bool = False) -> DataFrame:
    """Figures of every document, and with ``with_groups`` its groups as ``a1,a2|b1;a3|b2``."""
    cut = pieces(docs, path_a, path_b, size, work)
    counts = pair_counts(cut, path_a, path_b)  # merged again where needed: less than writing them
    total = counts.groupBy("_pair").agg(F.sum("_n").alias("_total")).withColumn("_b", F.shiftright("_pair", 32))
    highest = total.groupBy("_b").agg(F.max("_total").alias("_most"))
    total = total.join(highest, "_b").select("_pair", "_total", (F.col("_total") == F.col("_most")).alias("_best"))
    own = counts.select("_piece", "_pair").join(total, "_pair").groupBy("_piece").agg(F.collect_list(F.struct("_pair", "_total", "_best")).alias("_own"))
    parts = cut.join(own, "_piece", "left").mapInArrow(_figures(path_a, path_b, with_groups), _PART).repartition("_key").sortWithinPartitions("_key", "_piece")
    out = parts.mapInArrow(_stitch(with_groups), _OUT)
    return out if with_groups else out.drop("groups")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
