"""Quality rules against a brute-force count."""
import random
import re
from collections import Counter

from conftest_llm import EDGE
from scanforge.llm.op9_quality import bad_share, compression_bands, op9_compression_bands

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = W.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if W.search(x) and x in lines[:i])
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def prose(rng, n):
    syllables = ["ta", "re", "mo", "lin", "der", "sa", "vo", "ki", "pra", "ne", "sto", "wel"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_counts(make_docs):
    rng = random.Random(3)
    rows = EDGE + [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(200, "a#b $ |<>| **\nsame line\nsame line\n\n\nsame line"), (201, prose(rng, 30) + "\n" + "x y z " * 9)]
    got = sorted([tuple(r)[:7] for r in compression_bands(make_docs(rows, extra=("kept", "ratio"))).collect()], key=str)
    assert got == sorted([(d, *brute(t)) for d, t in rows], key=str)


def test_verdicts(make_docs):
    rng = random.Random(5)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(rng.randint(5, 30))) for _ in range(400))
    mixed = prose(rng, 1500) + " " + " ".join("".join(chr(rng.randint(33, 0x24F)) for _ in range(12)) for _ in range(3000))
    periodic = " ".join(f"{i % 10}" + "abcdefgh" * 12 for i in range(9)) + " " + " ".join(["q" * (i + 1) for i in range(40)])
    rows = [(1, prose(rng, 400)), (2, noise), (3, prose(rng, 25)), (4, periodic), (5, mixed), (6, prose(rng, 30000))]
    got = {r.doc_id: r.verdict for r in compression_bands(make_docs(rows)).collect()}
    assert got == {1: "kept", 2: "incompressible", 3: "kept", 4: "repetitive", 5: got[5], 6: "kept"} and got[5] != "kept"


def test_query_and_empty_table(sf, spark):
    out = op9_compression_bands(spark, sf(EDGE))
    assert out.count() == len(EDGE) and out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                            "base_failed", "kept"]
    assert op9_compression_bands(spark, sf([], "none")).count() == 0


def test_random_words_are_incompressible_at_every_length(make_docs):
    rng = random.Random(8)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    junk = lambda n, of=signs: " ".join("".join(rng.choice(of) for _ in range(4)) for _ in range(n))[:n]
    rows = [(100 * n + k, junk(n)) for n in (100, 200, 400, 800, 2000, 4000, 9000) for k in range(5)]
    rows += [(7 + k, junk(9000, signs[:26])) for k in range(3)]
    rows += [(1 + k, prose(rng, n)) for k, n in enumerate((25, 60, 120, 300, 700))]
    # less than half of its bytes are junk
    text = prose(rng, 2000)[:4096]
    rows.append((20, text + " " + junk(2000)))
    got = {r.doc_id: r.verdict for r in compression_bands(make_docs(rows)).collect()}
    assert {d: v for d, v in got.items() if d >= 10000 and v != "incompressible"} == {}
    assert all(got[7 + k] == "incompressible" for k in range(3))
    assert all(got[1 + k] == "kept" for k in range(5)) and got[20] == "kept"


def test_last_chunk_is_measured():
    import zstandard
    rng, z = random.Random(9), zstandard.ZstdCompressor(level=3)
    junk = bytes(rng.randrange(33, 127) for _ in range(3000))
    text = prose(rng, 2000).encode()[:4096]
    assert bad_share(text, z) == 0 and bad_share(text + junk, z) == 3000 / 7096 and bad_share(junk, z) == 1
