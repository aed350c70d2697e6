import math
import re
from collections import Counter

import pytest
from conftest_llm import EDGE
from pyspark.sql import functions as F

from scanforge.llm import op12_lexical_search as op

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain(docs, items, k=20):
    """Every document scored for every item."""
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, words = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in sorted(set((i, t) for i, t in items if t is not None)):
        found, wanted = [], Counter(plain_terms(text))
        for d, b, x in bags:
            m = 75 + 25 * x * n // words
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t, c in wanted.items() if b[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def run(make_docs, spark, docs, items, **more):
    found = op.ranked_search(make_docs(docs, extra=more.pop("extra", ())), spark.createDataFrame(items, "item_id bigint, text string"), **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=key)


ITEMS = [(1, "one two, TWO x"), (2, None), (3, "!!"), (4, "Éa 漢字 y"), (5, "unknown words"), (6, "word one"), (6, "word one"), (7, "a" * 5000)]


def test_edge_rows_and_clashing_columns(make_docs, spark):
    want = sorted(plain(EDGE, ITEMS), key=key)
    assert run(make_docs, spark, EDGE, ITEMS, extra=("_bag", "_class", "item_id", "score", "rank")) == want
    assert run(make_docs, spark, EDGE, ITEMS, block_bytes=20) == want  # several blocks of items


def test_classes_of_copies_expand_by_doc_id(make_docs, spark):
    texts = ["alpha beta", "beta alpha", "alpha beta gamma", "gamma gamma alpha", "delta", "Alpha-Beta"]
    docs = [(100 - i, texts[i % 6]) for i in range(100)] + [(7, "alpha beta")] * 3
    items = [(1, "alpha"), (2, "gamma beta"), (3, "delta delta alpha")]
    for k in (1, 3, 20):
        assert run(make_docs, spark, docs, items, k=k) == sorted(plain(docs, items, k), key=key)


def test_small_matrices_and_wide_scores(make_docs, spark, monkeypatch):
    monkeypatch.setattr(op, "_CELLS", 4)
    docs = [(i, " ".join(f"w{j}" for j in range(i % 13))) for i in range(60)]
    items = [(i, f"w{i} w{i + 1} w{i % 3}") for i in range(8)]
    assert run(make_docs, spark, docs, items) == sorted(plain(docs, items), key=key)
    long = [(1, "w1 " * 400_000)]  # sums above 2^53: added as integers
    assert op.grouped([{0: 400_000}], op.np.array([25_000]))[0].matrix.dtype == op.np.int64
    assert run(make_docs, spark, docs, long) == sorted(plain(docs, long), key=key)


def test_long_text_and_empty_tables(make_docs, spark):
    docs = [(1, "needle " + "hay Straw-9 " * 300_000), (2, "needle"), (3, "straw")]
    items = [(1, "needle straw"), (2, "hay")]
    assert run(make_docs, spark, docs, items) == sorted(plain(docs, items), key=key)
    assert run(make_docs, spark, [], items) == []
    assert run(make_docs, spark, [(1, None), (2, "--")], items) == []
    assert run(make_docs, spark, docs, []) == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query_against_every_score(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = op.op12_lexical_search(spark, sf_dir)
    assert found.agg(F.max("rank")).first()[0] == 20
    assert sorted(map(tuple, found.collect())) == sorted(plain(docs, items))
