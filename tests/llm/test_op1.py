"""Exact dedup against a plain grouping, and the trie on its own."""
import hashlib
import random
from collections import defaultdict

from conftest_llm import EDGE
from scanforge.llm.op1_exact_dedup import PatriciaTrie, exact_dedup, op1_exact_dedup


def brute(rows, largest=True):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out, seen = [], set()
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        kept = d == keep and (d, t or "") not in seen
        seen.add((d, t or ""))
        out.append((d, keep, len(groups[t or ""]), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, rows, largest=True):
    assert sorted([tuple(r) for r in df.collect()], key=str) == brute(rows, largest)


def test_against_brute_force(make_docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot text", f"t{rng.randint(0, 40)}", f"own {i}", "x" * rng.randint(0, 9)])) for i in range(500)] + EDGE
    docs = make_docs(rows, extra=("kept", "_h", "keep_id"), parts=7)
    check(exact_dedup(docs, largest=True), rows)
    check(exact_dedup(docs, largest=False), rows, largest=False)
    check(exact_dedup(docs, largest=True, budget=200), rows)  # spills all the time


def test_trie_spills_and_merges():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(400)]
    trie, out = PatriciaTrie(largest=False), defaultdict(lambda: [10 ** 9, 0])
    for i, k in enumerate(keys):
        trie.insert(k, i)
        if len(trie) > 600:
            for key, owner, n in trie.spill(300):
                out[key] = [min(out[key][0], owner), out[key][1] + n]
            assert len(trie) <= 300 or not trie.root.kids
    for key, owner, n in trie.leaves():
        out[key] = [min(out[key][0], owner), out[key][1] + n]
    assert dict(out) == {k: [keys.index(k), keys.count(k)] for k in set(keys)}


def test_query_and_empty_table(sf, spark):
    check(op1_exact_dedup(spark, sf(EDGE)), EDGE)
    assert op1_exact_dedup(spark, sf([], "none")).count() == 0
