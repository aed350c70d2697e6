import random
import re

import numpy as np
from conftest_llm import EDGE

from scanforge.llm import op13_minhash_dedup as op

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def all_pairs(docs, percent=80):
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    found = [(d, len(sets[i]), least.get(top(i), d)) for i, (d, _) in enumerate(docs)]
    return sorted(((d, n, c, d == c) for d, n, c in found), key=str)


def check(df, docs, percent=80):
    assert sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == all_pairs(docs, percent)


def chains(seed, groups, length, words=60, edits=4):
    """Groups of texts, each made from an earlier one of its group by changing some words."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        texts = [[f"g{g}w{rng.randrange(400)}" for _ in range(words)]]
        for _ in range(length - 1):
            new = list(rng.choice(texts[-3:]))
            for _ in range(rng.randrange(1, edits + 1)):
                new[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
            texts.append(new)
        out += [" ".join(t) for t in texts]
    rng.shuffle(out)
    return list(enumerate(out))


def test_edge_rows_and_clashing_columns(make_docs):
    check(op.near_classes(make_docs(EDGE, extra=("_c", "kept", "component_id", "_root"))), EDGE)


def test_chains_that_leave_their_hub(make_docs):
    docs = chains(3, 3, 60)
    check(op.near_classes(make_docs(docs)), docs)
    check(op.near_classes(make_docs(docs), block=3), docs)


def test_one_large_group_of_near_copies(make_docs, monkeypatch):
    monkeypatch.setattr(op, "FAN", 20)  # a hub's edges in several parts
    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    docs = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(5000 + i, "copy of one text") for i in range(100)]
    check(op.near_classes(make_docs(docs)), docs)


def test_links_between_members_that_the_hub_does_not_see(make_docs, spark):
    """All share a bucket by hand: the hub is near none, two pairs of others are near."""
    texts = [" ".join(f"{p}{i}" for i in range(40)) for p in "abc"]
    texts += [t + " more" for t in texts]
    sets = [np.unique(s) for s in op._sets_of(op.pa.array([t.encode() for t in texts]), 2)]
    sigs = op.signatures(sets, 128, op.orders(128)).astype(np.uint16)
    rows = [(bytes([i]) * 16, 7, 3, len(sets[i]), 6) for i in range(6)]
    members = spark.createDataFrame(rows, "_c binary, _k bigint, _band int, _n int, _m bigint")
    hubs, edges = op.star_edges(members, 80)
    assert hubs.count() == 1 and edges.count() == 5
    table = spark.createDataFrame([(r[0], s.tobytes()) for r, s in zip(rows, sets, strict=True)], "_c binary, _set binary")
    seen = {(bytes(a)[0], bytes(b)[0]) for a, b in op.confirmed(edges, table, 80).collect()}
    assert seen == {(5, 2)}
    roots = spark.createDataFrame([(bytes([2]) * 16, bytes([2]) * 16), (bytes([5]) * 16, bytes([2]) * 16)], "_c binary, _root binary")
    signed = spark.createDataFrame([(r[0], r[3], s.tobytes(), x.tobytes()) for r, s, x in zip(rows, sigs, sets, strict=True)], "_c binary, _n int, _sig binary, _set binary")
    for block in (1, 2, 256):
        tiles = op.open_members(members, hubs, roots, block).join(signed, "_c").withColumn("_band", op.F.lit(0))
        rows_of = tiles.repartition("_k", "_block").sortWithinPartitions("_k", "_block", op.F.desc("_out"))
        found = {tuple(sorted((bytes(a)[0], bytes(b)[0]))) for a, b in rows_of.mapInArrow(op._compare(4, 0.6, 80), "a binary, b binary").collect()}
        assert found == {(0, 3), (1, 4)}


def test_recall_of_bands_at_the_threshold():
    rng = np.random.default_rng(2)
    order = op.orders(128)
    for n in (5, 20, 200):
        met = 0
        for _ in range(200):
            x = np.unique(rng.integers(0, 1 << 63, n + n // 4 + 9, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(x[rng.permutation(len(x))][:n]), None
            b = a[rng.permutation(n)][:-(-n * 8 // 10)]
            keys = op.band_keys(op.signatures([a, np.sort(b)], 128, order), 4)
            met += bool((keys[0] == keys[1]).any())
        assert met == 200


def test_densified_bins_copy_filled_ones():
    order = op.orders(16)
    assert (np.sort(order, axis=1) == np.arange(16)).all() and (order[:, 0] == np.arange(16)).all()
    one = np.array([12345], np.uint64)
    assert len(set(op.signatures([one], 16, order)[0].tolist())) == 1


def test_long_text_and_empty_table(make_docs):
    words = " ".join(f"w{i}" for i in range(400_000))
    docs = [(1, words), (2, words + " tail"), (3, "short"), (4, words[:100_000])]
    check(op.near_classes(make_docs(docs)), docs)
    assert op.near_classes(make_docs([])).collect() == []
    check(op.near_classes(make_docs([(1, None), (2, "")])), [(1, None), (2, "")])


def test_query_against_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(op.op13_minhash_dedup(spark, "/root/testdata/sf0.001"), docs)
