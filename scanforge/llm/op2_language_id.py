"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn from a hash of its
code point. A trigram is the product of its letters' vectors, the first rotated
twice, the second once. A document is the sum of its trigram vectors; a
language is the sum of its documents' vectors, each scaled to its length. A
document gets the language whose vector has the largest cosine.

Learning reads text and lang of the rows outside the held-out third and sums
one vector per language (partial sums per task, in whole numbers, so the order
of summing does not matter); only languages x DIM numbers reach the driver, at
most ``MAX_LANGS`` languages. Prediction is one narrow pass that reads doc_id
and text.

Defined cases: ``und`` with score 0 for a null text, one without a letter, or
where no language was learned; ties go to the first language by code point; a
null doc_id counts as the empty text in the split; each row gives one row.

The pipeline's stage drops a document only when its score is no better than
chance at its own length (see ``least_score``). Where no language was learned
there is nothing to judge by, and every document passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import documents, mix64, slices

DIM, MAX_LANGS, UNDETERMINED = 1024, 4096, "und"
#: the pipeline expects of a document this share of the cosine that a text of its length has in its language,
#: less this many standard deviations of the sign vectors' noise, and never more than that many above chance
SHARE, DEVIATIONS = 1 / 3, 3
_GRAMS_AT_ONCE, _SLICE, _ROWS = 4096, 1 << 20, 256
_SPACE = 32
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of DIM signs (int8) per code point."""
    with np.errstate(over="ignore"):
        words = mix64(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def letters_of(text: str | None) -> np.ndarray | None:
    """Lower-case code points, every run of other characters one space, with a space at both ends; None without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    out = np.full(len(codes) + 2, _SPACE, np.uint32)
    out[1:-1][letter] = codes[letter]
    return out[np.concatenate([[True], (out[1:] != _SPACE) | (out[:-1] != _SPACE)])]


class Trigrams:
    """Trigram counts of some texts, and products with trigram vectors, a bounded number of trigrams at a time."""

    def __init__(self, texts: list[str | None]):
        docs = [letters_of(t) for t in texts]
        self.has = np.array([d is not None for d in docs], bool)
        docs = [d for d in docs if d is not None]
        self.size = len(docs)
        if not docs:
            return
        self.alphabet, flat = np.unique(np.concatenate(docs), return_inverse=True)
        n, at, found = len(self.alphabet), 0, []
        for d in docs:
            x = flat[at:at + len(d)].astype(np.int64)
            at += len(d)
            found.append(np.unique((x[:-2] * n + x[1:-1]) * n + x[2:], return_counts=True))
        self.grams, self.column = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        self.count = np.concatenate([c for _, c in found]).astype(np.float32)
        self.row = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])

    def vectors(self, row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """Sum of weight x trigram vector by row."""
        n = len(self.alphabet)
        base = letter_vectors(self.alphabet)
        first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        out = np.zeros((rows, DIM), np.float32)
        order = np.argsort(self.column, kind="stable")
        ends = np.searchsorted(self.column[order], np.arange(0, len(self.grams) + _GRAMS_AT_ONCE, _GRAMS_AT_ONCE))
        for k in range(len(ends) - 1):
            g = self.grams[k * _GRAMS_AT_ONCE:(k + 1) * _GRAMS_AT_ONCE]
            bound = (first[g // (n * n)] * second[g // n % n] * base[g % n]).astype(np.float32)
            some = order[ends[k]:ends[k + 1]]
            at = row[some] * len(g) + self.column[some] - k * _GRAMS_AT_ONCE
            out += np.bincount(at, weight[some], rows * len(g)).astype(np.float32).reshape(rows, len(g)) @ bound
        return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text", _SLICE, _ROWS):
            t = Trigrams(part.column("text").to_pylist())
            if not t.size:
                continue
            langs = np.array(part.column("lang").to_pylist(), object)[t.has]
            names, of = np.unique(langs.astype(str), return_inverse=True)
            share = t.count / np.bincount(t.row, t.count)[t.row]
            for name, v in zip(names, t.vectors(of[t.row], share.astype(np.float32), len(names)), strict=True):
                sums[name] = sums.get(name, 0) + v.astype(np.float64)
            for name, k in zip(names, np.bincount(of), strict=True):
                texts[name] = texts.get(name, 0) + int(k)
    for name, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * (DIM + 1)), pa.array(np.arange(DIM + 1, dtype=np.int32)),
                                          pa.array(np.rint(np.append(v, texts[name]) * (1 << 16)).astype(np.int64))], names=["lang", "dim", "v"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their unit vectors, from the rows of ``docs`` that are not held out."""
    return learn_weights(docs)[:2]


def learn_weights(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same, and per language the length of its distribution over trigrams: 1 if all are the same one, near 0 if all differ."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = rows.mapInArrow(_partial_sums, "lang string, dim int, v bigint").groupBy("lang", "dim").agg(F.sum(F.col("v").cast("decimal(30,0)")).cast("double").alias("v"))
    found = sums.limit(MAX_LANGS * (DIM + 1) + 1).collect()
    if len(found) > MAX_LANGS * (DIM + 1):
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted({r[0] for r in found}, key=str.encode)
    out = np.zeros((len(langs), DIM + 1))
    at = {x: i for i, x in enumerate(langs)}
    for lang, dim, v in found:
        out[at[lang], dim] = v
    out, texts = out[:, :DIM], out[:, DIM:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, out / np.maximum(norm, 1e-12), (norm / np.maximum(texts, 1) / DIM ** 0.5)[:, 0]


def _judge(t: Trigrams, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its cosine of every text with letters."""
    v = t.vectors(t.row, t.count, t.size)
    cosines = v @ profiles.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return np.argmax(cosines, axis=1), np.clip(cosines.max(axis=1), 0, 1)


def _predict(langs: list[str], profiles: np.ndarray):
    profiles = profiles.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE, _ROWS):
                t = Trigrams(part.column("text").to_pylist())
                lang, score = np.full(part.num_rows, UNDETERMINED, object), np.zeros(part.num_rows)
                if t.size and langs:
                    best, cosine = _judge(t, profiles)
                    lang[t.has] = np.array(langs, object)[best]
                    score[t.has] = cosine
                rest = [i for i, x in enumerate(part.schema.names) if x != "text"]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in rest] + [pa.array(lang, pa.string()), pa.array(score)],
                                                 names=[part.schema.names[i] for i in rest] + ["lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray) -> DataFrame:
    """doc_id, _th, held_out, lang_pred, score of every row."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(langs, profiles), f"doc_id {kind}, _th bigint, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, *learn(docs)).drop("_th")


def least_score(n: np.ndarray, weight: np.ndarray, langs: int) -> np.ndarray:
    """The cosine that a text of ``n`` trigrams must reach to stay in a language of that ``weight``.

    Of n trigrams drawn from the language, the cosine is about
    sqrt(n) x weight / sqrt(1 + (n - 1) x weight^2): it grows with n, so a fixed
    limit would measure length. Trigrams of no learned language give noise of
    standard deviation 1 / sqrt(DIM), whatever n is; the best of several
    languages lies sqrt(2 ln languages) of them higher. A short text, whose own
    language may stay inside that noise, is never rejected.
    """
    expected = np.sqrt(n) * weight / np.sqrt(1 + (n - 1) * weight ** 2)
    chance = (np.sqrt(2 * np.log(max(langs, 1))) + DEVIATIONS) / DIM ** 0.5
    return np.minimum(SHARE * expected - DEVIATIONS / DIM ** 0.5, chance)


def _keep(profiles: np.ndarray, weights: np.ndarray):
    profiles = profiles.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE, _ROWS):
                t = Trigrams(part.column("text").to_pylist())
                good = t.has.copy()
                if t.size:
                    best, cosine = _judge(t, profiles)
                    total, squares = np.bincount(t.row, t.count), np.bincount(t.row, t.count.astype(np.float64) ** 2)
                    # repeated trigrams say nothing new: the number of equally frequent ones that would be as varied
                    good[t.has] = cosine >= least_score(total ** 2 / squares, weights[best], len(weights))
                yield part.filter(pa.array(good))

    return run


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those undetermined or no better than chance at their length go. A null lang stays null.

    Where no language was learned, all documents stay.
    """
    cols = docs.select("doc_id", "text", "lang", "source", "n_chars")
    langs, profiles, weights = learn_weights(docs)
    return cols.mapInArrow(_keep(profiles, weights), cols.schema) if langs else cols
