"""Repeated passages against a count of all windows; the index against plain matches."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGE
from scanforge.llm import op6_repeats as o


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    often = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if often[t[i:i + length]] > 1:
                gone[i:i + length] = True
        rest = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "re", "mo", "lin", "der", "sé"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    passages = [prose(rng, k) for k in (20, 30, 60, 200)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000 + i, rows[i][1].replace("ta", "TA", 1)) for i in range(8)]
    rows += [(3000, "a" * 900), (3001, "ab" * 300), (3002, "x" * 199), (3003, "x" * 200), (3004, prose(rng, 90) * 2), (3005, "a" * 250 + "b" + "a" * 250)]
    return rows + [(d, t and t[:3000]) for d, t in EDGE]


def test_matching_statistics():
    rng = random.Random(3)
    for letters, lengths in ((b"ab", (1, 40)), (b"abc", (5, 300)), (b"a", (1, 30)), (bytes(range(256)), (10, 50))):
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(12)]
        strings += [strings[0], strings[1][2:], strings[2] + strings[3], strings[2]]
        strings = [s for s in strings if s]
        index = o.RunLengthIndex(strings)
        got = index.matching_statistics().tolist()
        every = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
        want = []
        for k, i in every:
            best = 0
            for m, j in every:
                if (m, j) != (k, i):
                    x, y = strings[k][i:], strings[m][j:]
                    n = next((q for q, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
                    best = max(best, n)
            want.append(best)
        assert got == want
        assert int(index.lengths.sum()) == len(every) and (index.letters[1:] != index.letters[:-1]).all()


def test_stretches_cover_every_window_once():
    rng = random.Random(4)
    texts = [prose(rng, k).encode() for k in (0, 3, 50, 400, 20)] + [b"z" * 500, b"y" * 200]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    a, x, text, p, n, _, times = o.stretches(data, ends)
    assert times[text == 5].tolist() == [301]
    text, p, n = (np.repeat(v, times) for v in (text, p, n))
    p = p + np.concatenate([np.arange(k) for k in times]) * n
    seen = Counter((t, q) for t, first, k in zip(text.tolist(), p.tolist(), n.tolist(), strict=True) for q in range(first, first + k))
    assert set(seen.values()) == {1} and set(seen) == {(k, q) for k, t in enumerate(texts) for q in range(len(t) - 199)}


@pytest.mark.parametrize("group", [1024, 3])
def test_against_brute_force(make_docs, monkeypatch, group):
    monkeypatch.setattr(o, "GROUP", group)  # 3: nearly every group is split
    rows = corpus()
    got = o.remove_repeats(make_docs(rows, extra=("n_bytes", "_a", "_key")), digest=True).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_blocks_of_giant_texts(make_docs, monkeypatch):
    rng = random.Random(6)
    long = prose(rng, 900)
    rows = [(1, long), (2, prose(rng, 50) + long[500:3500] + prose(rng, 50)), (3, prose(rng, 300))]
    cut = [(at, len(b)) for at, b in o._blocks(long.encode())]
    assert cut == [(0, len(long.encode()))]
    data = long.encode()
    monkeypatch.setattr(o, "_BLOCK", 700)
    found = Counter(q for at, b in o._blocks(data) for q in range(at, at + len(b) - 199))
    assert set(found.values()) == {1} and len(found) == len(data) - 199
    got = o.remove_repeats(make_docs(rows), digest=True).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)


def test_query_and_empty_table(sf, spark):
    rows = corpus(2, 10)
    assert sorted([tuple(r) for r in o.op6_repeats(spark, sf(rows)).collect()], key=str) == brute(rows)
    assert o.op6_repeats(spark, sf([], "none")).count() == 0
