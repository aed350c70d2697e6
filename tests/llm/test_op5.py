"""Mixing against a plain walk through the drawn slots."""
import random
import re

import numpy as np
import pytest
from conftest_llm import EDGE
from scanforge.llm import op5_mixing as o


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    x = o.permute(np.arange(n), n, 12345)
    assert sorted(x.tolist()) == list(range(n)) and (o.permute(x, n, 12345, forward=False) == np.arange(n)).all()


def test_targets():
    assert o.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert o.targets([0, 10, 0, 10]) == pytest.approx([0, 10, 0, 20])
    assert o.targets([]) == [] and o.targets([0, 0]) == [0.0, 0.0]
    for sizes in ([5, 1000, 3, 40, 2, 900], [1], [7, 7], [10 ** 6, 1, 1, 1]):
        t = o.targets(sizes)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 60, 700]))), "en", rng.choice(["big", "big", "big", "b", "c", None, "é"])) for i in range(300)]
    return rows + [(d, t, "en", "b") for d, t in EDGE]


@pytest.mark.parametrize("block", [16, 1024])
def test_taken_words(make_docs, block):
    rows = corpus()
    docs = make_docs(rows, extra=("size", "target", "_no"))
    pieces = o.mix(docs, block=block).collect()
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, o.targets([size[s] for s in order]), strict=True))
    taken, per = {}, {}
    for p in pieces:
        taken[p._no] = taken.get(p._no, 0) + p.words
        per[p.doc_id, p._th, p._no, p._start] = per.get((p.doc_id, p._th, p._no, p._start), 0) + p.words
        assert p.target == pytest.approx(target[order[p._no]]) and p.source_size == size[order[p._no]]
        assert p.shard is None or 0 <= p.first <= p.first + p.words <= p.size
    for no, s in enumerate(order):
        assert taken.get(no, 0) == int(target[s] + 0.5)
    slots = {(p._no, p.epoch, p.slot) for p in pieces if p.shard is not None}
    blocks = {}
    for p in pieces:
        if p.shard is not None:
            blocks.setdefault((p._no, p.block), set()).add((p.epoch, p.slot))
    assert all(len({e for e, _ in x}) == len(x) <= 2 for x in blocks.values()) and len(slots) == sum(len(x) for x in blocks.values())
    sizes = {(p.doc_id, p._th, p._no, p._start): p.size for p in pieces}
    assert all(per[k] <= 2 * sizes[k] for k in per)


def test_query_reruns_and_empty_tables(sf, spark):
    path = sf(corpus())
    a, b = (sorted([tuple(r) for r in o.op5_mixing(spark, path).collect()], key=str) for _ in range(2))
    assert a == b and len(a) == len(corpus())
    assert o.op5_mixing(spark, sf([], "none")).count() == 0
    assert [tuple(r) for r in o.op5_mixing(spark, sf([(1, None, "en", None), (2, " ", "en", "a")], "blank")).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_shards_get_multinomial_counts(spark):
    plan = o.source_plan([("a", 60_000), ("b", 30_000)], block=1)
    drawn = o.draw_slots(spark, plan, block=1, shard_blocks=10_000).toPandas()
    counts = drawn.groupby(["shard", "_no"]).size().unstack()
    assert len(counts) == 14 and (counts.std() < 4 * np.sqrt(counts.mean())).all() and (counts.std() > 0).all()


def test_slots_are_drawn_by_several_tasks(spark):
    from pyspark.sql import functions as F
    drawn = o.draw_slots(spark, o.source_plan([("a", 300_000), ("b", 100_000)], block=1), block=1)
    assert drawn.groupBy(F.spark_partition_id()).count().count() > 4


def test_stage(make_docs, spark):
    rows = [(i, "a b c d", "en", "x" if i % 2 else "y") for i in range(400)]
    out = o.mixing_stage(spark, make_docs(rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [r.doc_id for r in out.collect()]
    n = {s: sum(1 for d in got if (d % 2 == 1) == (s == "x")) for s in "xy"}
    t = dict(zip("xy", o.targets([800, 800]), strict=True))
    assert all(abs(4 * n[s] - t[s]) < 0.15 * t[s] for s in "xy") and max(got.count(d) for d in set(got)) <= 2
