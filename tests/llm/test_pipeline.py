"""The pipeline against brute-force versions of its stages on a small corpus."""
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import sentencepiece
from conftest_llm import EDGE
from scanforge.llm import op7_sentencepiece as sp
from scanforge.llm.op5_mixing import targets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(11)
    words = {"en": ["the", "and", "ing", "tion", "her"], "de": ["der", "und", "sch", "ein", "keit"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "de"])
        prose = lambda n: " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))  # noqa: E731, B023
        lines = [prose(rng.randint(5, 30)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "Accept all cookies" if i % 2 else " ACCEPT all cookies\t")
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    for k in range(10):
        d, t, lang, s = rows[k * 7]
        rows += [(500 + k, t, lang, s), (600 + k, t + " extra", lang, s)]
    return rows + [(1000 + i, t, "en", None) for i, (_, t) in enumerate(EDGE)] + [(2000, "12 34 56 --", "en", "s0")]


def after_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = defaultdict(set)
    for d, t in rows:
        for x in t.split("\n"):
            seen[key(x)].add((d, t))
    out = {}
    for d, t in rows:
        lines = [x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10]
        if len(lines) == t.count("\n") + 1 or WORD.search("\n".join(lines)):
            out[d] = "\n".join(lines)
    return out


def shingles(t):
    w = WORD.findall(t)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def after_near(texts):
    ids = sorted(texts)
    sets = {d: shingles(texts[d]) for d in ids}
    root = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] > root[b]:
                    root[a], changed = root[b], True
    return {d: texts[d] for d in ids if root[d] == d}


def test_stages(make_docs, spark, tmp_path):
    rows = corpus()
    docs, kept = make_docs(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "sentencepiece"]

    first = {r.doc_id: r.text for r in kept["language_id"]}
    assert {d for d, t, *_ in rows if d < 900} <= set(first) and 2000 not in first and 1000 not in first and 1001 not in first
    lines = after_lines([(r.doc_id, r.text) for r in kept["language_id"]])
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == lines and all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    near = after_near(lines)
    assert {r.doc_id: r.text for r in kept["jaccard_join"]} == near and len(near) < len(lines)

    size = Counter()
    for r in kept["jaccard_join"]:
        size[r.source] += len(WORD.findall(r.text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, targets([size[s] for s in order]), strict=True))
    got = Counter()
    for r in kept["mixing"]:
        got[r.source] += len(WORD.findall(r.text))
        assert near[r.doc_id] == r.text
    assert max(Counter(r.doc_id for r in kept["mixing"]).values()) <= 2
    assert all(abs(got[s] - want[s]) <= 0.25 * want[s] + 60 for s in order)

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    assert sorted((r.doc_id, r.ids) for r in kept["sentencepiece"]) == sorted((r.doc_id, lib.encode(r.text)) for r in kept["mixing"])


def test_run_and_empty_table(sf, spark):
    path = sf(corpus())
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "n_parts", "ids"] and out.count() > 100
    assert corpus_pipeline.run(spark, sf([], "none")).count() == 0
