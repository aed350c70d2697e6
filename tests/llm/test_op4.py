"""Sharding: the table against a plain filling, balance, small disruption."""
from collections import Counter

import pytest
from conftest_llm import EDGE
from scanforge.llm.op4_sharding import lookup_table, op4_sharding, place, write_shards

NAMES = [f"s{i}" for i in range(10)]


def test_table_is_filled_by_turns_of_preference():
    import hashlib

    slots, free = 101, set(range(101))
    prefs = []
    for x in NAMES:
        d = hashlib.sha256(x.encode()).digest()
        at, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        prefs.append([(at + k * step) % slots for k in range(slots)])
        assert len(set(prefs[-1])) == slots
    want = {}
    while free:
        for i, p in enumerate(prefs):
            if free:
                want[s := next(x for x in p if x in free)] = i
                free.discard(s)
    assert lookup_table(NAMES, slots).tolist() == [want[s] for s in range(slots)]


def test_balance_and_disruption():
    full, less = lookup_table(NAMES, 10_007), lookup_table(NAMES[:-1], 10_007)
    sizes = Counter(full.tolist())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert ((full != less) & (full != 9)).sum() < 0.1 * len(full)
    for bad in (100, 7, 1 << 23):
        with pytest.raises(ValueError):
            lookup_table(NAMES, bad)


def test_places_every_row(make_docs, sf, spark, tmp_path):
    rows = EDGE + [(i, "t") for i in range(100, 400)] + [(None, f"n{i}") for i in range(50)]
    docs = make_docs(rows, extra=("shard", "slot"))
    got = place(docs, NAMES, 1009).collect()
    table = lookup_table(NAMES, 1009)
    assert len(got) == len(rows) and all(r.shard == table[r.slot] and r.shard_name == NAMES[r.shard] for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1 and len({r.shard for r in got if r.doc_id is None}) > 3
    write_shards(docs, f"{tmp_path}/out", NAMES, 1009)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} == {r.shard for r in got}
    assert op4_sharding(spark, sf(rows)).count() == len(rows) and op4_sharding(spark, sf([], "none")).count() == 0
