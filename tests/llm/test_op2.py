"""Language profiles: held-out accuracy, a plain version of the vectors, edge cases."""
import random
import zlib

import numpy as np
from conftest_llm import EDGE
from scanforge.llm import op2_language_id as o

WORDS = {"aa": ["the", "and", "of", "ing", "tion"], "bb": ["der", "und", "sch", "keit", "ein"], "cc": ["que", "les", "eau", "oi", "ment"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_vector(s):
    letters = o.letters_of(s)
    v = {int(c): o.letter_vectors(np.array([c]))[0].astype(int) for c in set(letters.tolist())}
    return sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(letters.tolist(), letters.tolist()[1:], letters.tolist()[2:], strict=False))


def test_vectors_match_the_plain_sum():
    texts = ["Hello, wörld 12 x", "a", "ÄÖ ß—ß " * 40, "漢字 かな"]
    t = o.Trigrams([None, *texts, "123 --", ""])
    assert t.has.tolist() == [False, True, True, True, True, False, False]
    got = t.vectors(t.row, t.count, t.size)
    for v, s in zip(got, texts, strict=True):
        assert (v == plain_vector(s)).all()


def test_held_out_accuracy_and_edges(sf, spark):
    rng = random.Random(7)
    rows = [(i, text(rng, lang := rng.choice(["aa", "bb", "cc"]), rng.randint(8, 60)), lang) for i in range(300)]
    odd = [(1000 + i, t, None) for i, (_, t) in enumerate(EDGE)] + [(2000, "12 34 --", "aa"), (None, "the and of", "aa")]
    out = {r.doc_id: r for r in o.op2_language_id(spark, sf(rows + odd)).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(out[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[2000].lang_pred == "und" and out[2000].score == 0 and out[1000].lang_pred == "und"
    assert out[1003].lang_pred in WORDS


def test_nothing_learned_and_empty_table(sf, spark):
    out = o.op2_language_id(spark, sf([(1, "some text", None), (2, None, "aa")])).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}
    assert o.op2_language_id(spark, sf([], "none")).count() == 0


def test_stage(make_docs, spark):
    rng = random.Random(9)
    rows = [(i, text(rng, "aa", 30), "aa") for i in range(30)] + [(100, "123 456", "aa"), (101, None, "aa"), (102, text(rng, "aa", 20), None)]
    out = o.language_stage(spark, make_docs(rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in out.collect()} == {*range(30), 102}


def test_stage_keeps_short_texts_and_drops_noise(make_docs, spark):
    rng = random.Random(12)
    # languages with many trigrams: a short text meets few of them
    stems = {lang: ["".join(rng.choice(cons) + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(600)] for lang, cons in
             (("aa", "bcdfglmnprst"), ("bb", "hjkqvwxyzrst"))}
    clean = lambda lang, n: " ".join(rng.choice(stems[lang]) for _ in range(n))
    rows = [(i, clean(lang := rng.choice(["aa", "bb"]), 80), lang) for i in range(200)]
    short = [(1000 + i, clean(lang := rng.choice(["aa", "bb"]), 1 + i % 5), lang) for i in range(300)]
    short += [(2000, "la " * 40, "aa"), (2001, "Avec.", "aa"), (2002, "All rights reserved.", "bb")]
    noise = [(3000 + i, " ".join("".join(chr(rng.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(60)), None) for i in range(40)]
    out = {r.doc_id for r in o.language_stage(spark, make_docs(rows + short + noise), "").collect()}
    assert {r[0] for r in rows + short} <= out and not out & {r[0] for r in noise}


def test_stage_without_a_learned_language_passes_everything(make_docs, spark):
    rows = [(1, "some words here", None), (2, "Avec.", None), (3, None, None), (4, "12 34", None)]
    assert {r.doc_id for r in o.language_stage(spark, make_docs(rows), "").collect()} == {1, 2, 3, 4}
