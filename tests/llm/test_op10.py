"""Line dedup against a brute-force version."""
import hashlib
import random
from collections import defaultdict

from conftest_llm import EDGE
from pyspark.sql import functions as F
from scanforge.llm import op10_line_dedup as o
from scanforge.llm.op10_line_dedup import dedup_stage, drop_frequent_lines, op10_line_dedup
from scanforge.llm.op3_jaccard_join import near_dedup_stage

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs = {(d, t or "") for d, t in rows}
    seen = defaultdict(set)
    for d, t in docs:
        for x in t.split("\n"):
            if key(x):
                seen[key(x)].add((d, t))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(seen[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check(df, rows, least=10):
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()], key=str)
    assert got == brute(rows, least)


def rows_with_hot_line(n=400):
    rows = [(i, f"line {i}\n{'Hot Line' if i % 3 else ' hot line\t'}\nmid {i % 37}\nrare {i % 50}\nend{i}\nHOT LINE") for i in range(n)]
    return rows + [(1000 + i, t) for i, (_, t) in enumerate(EDGE)] + EDGE


def test_against_brute_force(make_docs, spark):
    rows = rows_with_hot_line()
    check(drop_frequent_lines(make_docs(rows, extra=("n_lines", "bitmap", "_h")), digest=True), rows)


def test_runs_across_many_partitions(make_docs, spark):
    rows = [(i, "hot\nl%d\nk%d" % (i, i // 11)) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(drop_frequent_lines(make_docs(rows, parts=7), digest=True), rows)
        check(drop_frequent_lines(make_docs(rows, parts=7), min_docs=299, digest=True), rows, 299)
        check(drop_frequent_lines(make_docs(rows, parts=7), min_docs=301, digest=True), rows, 301)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_and_empty_table(sf, spark):
    check(op10_line_dedup(spark, sf(EDGE)), EDGE)
    assert op10_line_dedup(spark, sf([], "none")).count() == 0


def test_stage_keeps_columns(make_docs, spark):
    docs = make_docs([(i, f"own {i}\nshared") for i in range(12)] + [(99, "shared"), (100, None)])
    out = dedup_stage(spark, docs, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[3] == ("own 3", 5) and 99 not in got and got[100] == ("", 0)


def clean_text(rng, n_lines):
    return "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(12)) for _ in range(n_lines))


def test_stage_leaves_one_of_a_copy_group(make_docs, spark):
    rng = random.Random(5)
    exact, near = clean_text(rng, 12), clean_text(rng, 25)
    changed = lambda i: "\n".join(f"own line {i} of this copy" if k == i % 25 else x for k, x in enumerate(near.split("\n")))
    rows = [(i, exact) for i in range(25)] + [(100 + i, changed(i)) for i in range(25)]
    rows += [(200 + i, clean_text(rng, 3) + "\nShared by all pages") for i in range(10)] + [(300, exact), (300, near)]
    out = dedup_stage(spark, make_docs(rows), "")
    left = sorted(near_dedup_stage(spark, out, "").collect())
    assert [r.doc_id for r in left] == [0, 100, *range(200, 210)]
    assert left[0].text == exact and left[1].text == changed(0) and all("Shared" not in r.text for r in left)


def test_large_classes_are_left_open(make_docs, spark, monkeypatch):
    monkeypatch.setattr(o, "_frequent", lambda least, real=o._frequent: real(least, most=7))
    rows = [(i, f"in class {i % 12 if i < 240 else 0}\nhot\nown {i}") for i in range(400)] + [(1000 + i, "rare\nin class 0") for i in range(9)]
    docs = make_docs(rows)
    classes = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.when(F.col("doc_id") < 240, F.col("doc_id") % 12).otherwise(0).cast("bigint").alias("_cd"),
                          F.lit(1).cast("bigint").alias("_ct"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        all_one = {r.doc_id: o._apply(dict(rows)[r.doc_id].encode(), r.bitmap)[0] for r in o.keep_bitmaps(docs, 10, classes).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(all_one) == list(range(400)) and all(v.decode() == dict(rows)[d].replace("\nhot", "") for d, v in all_one.items())
