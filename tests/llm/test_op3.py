"""Jaccard join against all pairs, components against a plain search."""
import random

import numpy as np
import pytest
from conftest_llm import EDGE
from scanforge.llm import op3_jaccard_join as o


def shingles(t):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        after = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if after == root:
            break
        root = after
    members = {}
    for i, r in enumerate(root):
        members.setdefault(r, []).append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in members[root[i]] if rows[j][0] is not None]
        copies = sum(1 for j in range(n) if sets[i] and sets[j] == sets[i]) or 1
        out.append((d, min(ids) if ids else None, len(near[i]), copies, len(members[root[i]])))
    return sorted(out, key=str)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    texts = [prose(rng.randint(1, 120)) for _ in range(120)]
    for _ in range(12):
        texts += near_copies(rng, prose(150), rng.randint(2, 9), 4)
    texts += near_copies(rng, prose(200), 90, 5)  # a large group of near copies
    texts += [prose(80)] * 30
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(5000 + i if d is not None else None, t) for i, (d, t) in enumerate(EDGE)]


@pytest.mark.parametrize("block", [256, 16])
def test_against_all_pairs(make_docs, block):
    rows = corpus()
    got = o.jaccard_classes(make_docs(rows, extra=("class_id", "_c", "_tree")), block=block)
    got = sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies, r.class_size) for r in got.collect()], key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g != w for g, w in zip(got, want, strict=True)) == 0  # recall at the threshold is 0.9999 a pair; these rows lose none


def test_differences_with_a_pivot_decide_links():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 270, False), rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in range(40)]
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    n = np.array([len(x) for x in sets])
    want = both >= 0.8 * (np.add.outer(n, n) - both) - 1e-9
    assert (o.overlaps(sets[:7], sets[5:]) == both[:7, 5:]).all() and 0 < want.sum() < want.size
    for pivot in (sets[0], sets[39], np.zeros(0, np.uint64)):
        d = [np.setxor1d(pivot, x) for x in sets]
        assert (o.near_pairs(d[:9], d[3:], n[:9], n[3:], 0.8) == want[:9, 3:]).all()


@pytest.mark.parametrize("edits", [1, 3, 6, 12])
def test_counts_by_band_and_tile(make_docs, edits, monkeypatch):
    """A group of near copies wider than a block: tight ones are counted by their bands, loose ones in tiles."""
    monkeypatch.setattr(o, "FAN", 30)
    rng = random.Random(edits)
    base = " ".join(f"b{i}" for i in range(240))
    rows = list(enumerate(near_copies(rng, base, 130, edits) + [base] * 3))
    got = o.jaccard_classes(make_docs(rows), block=8).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies, r.class_size) for r in got], key=str) == brute(rows)


def test_blocks_are_cut_by_bytes_too(make_docs, monkeypatch):
    monkeypatch.setattr(o, "BLOCK_BYTES", 400)
    rng = random.Random(8)
    rows = list(enumerate(near_copies(rng, " ".join(f"b{i}" for i in range(200)), 40, 4)))
    got = o.jaccard_classes(make_docs(rows)).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies, r.class_size) for r in got], key=str) == brute(rows)


def test_walk_shortens_to_the_recall():
    k = o.prefix_depth()
    assert 1 - (1 - 0.8 ** k) ** o.TREES >= o.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** o.TREES
    assert o.walk() == [8, 4] and o.walk(recall=0.9) == [8] and o.walk(threshold=0.5)[-1] == o.prefix_depth(0.5)


def test_prefixes_of_a_tree_are_nested():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k % 7:], rng.integers(0, 1 << 60, k % 5, dtype=np.uint64)])) for k in range(40)]
    keys, values = o.signatures(sets, 20, [8, 4])
    deep, short = (keys[:, d, :][:, None] == keys[:, d, :][None] for d in (0, 1))
    assert (short | ~deep).all() and 0 < deep.sum() < short.sum()  # who meets deeper meets in the shorter prefix too
    assert ((values.reshape(40, 20, 4)[:, None] == values.reshape(40, 20, 4)[None]).all(axis=3) == short).all()


def test_class_ids_alone(make_docs):
    rows = corpus(9)
    a, b = (o.jaccard_classes(make_docs(rows, (name,)), links=x) for name, x in (("_set", True), ("_root", False)))
    assert "n_links" not in b.columns
    assert sorted(map(str, a.drop("n_links").collect())) == sorted(map(str, b.collect()))


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(b"\x40", b"\x50"), (b"\x60", b"\x50")]
    got = {bytes(r.v): bytes(r.root) for r in o.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert got == {**{bytes([i]): b"\x00" for i in range(21)}, b"\x40": b"\x40", b"\x50": b"\x40", b"\x60": b"\x40"}


def test_query_empty_table_and_stage(sf, make_docs, spark):
    assert o.op3_jaccard_join(spark, sf(EDGE)).count() == len(EDGE)
    assert o.op3_jaccard_join(spark, sf([], "none")).count() == 0
    rng = random.Random(3)
    group = near_copies(rng, " ".join(f"a{i}" for i in range(200)), 6, 2)
    rows = [(10 + i, t) for i, t in enumerate(group)] + [(1, "alone here with some few words"), (2, ""), (3, None), (4, "one"), (4, "one")]
    out = o.near_dedup_stage(spark, make_docs(rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 10]
