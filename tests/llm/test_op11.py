import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import EDGE
from tokenizers import Tokenizer

from scanforge.llm import op11_alignment as op

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def walked(tokenizers, docs):
    """(doc_id, figures, groups): whole texts by the libraries, two pointers over the tokens."""
    a, b = tokenizers
    token = {i: t for t, i in a.get_vocab().items()}
    letters = op._byte_letters()
    piece = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    held, count = [], Counter()
    for doc_id, text in docs:
        groups, links = [], []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts = [bytes(letters[c] for c in token[i]) for i in ids[0]], [piece[i] for i in ids[1]]
            if b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
                at, ends, group = [0, 0], [len(parts[0][0]), len(parts[1][0])], ([ids[0][0]], [ids[1][0]])
                while True:
                    links.append((ids[0][at[0]], ids[1][at[1]]))
                    step = [0, 1] if ends[0] == ends[1] else [0] if ends[0] < ends[1] else [1]
                    if len(step) == 2:
                        groups.append(group)
                        group = ([], [])
                        if at[0] + 1 == len(ids[0]):
                            break
                    for k in step:
                        at[k] += 1
                        ends[k] += len(parts[k][at[k]])
                        group[k].append(ids[k][at[k]])
        count.update(links)
        held.append((doc_id, groups, links))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, groups, links in held:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((doc_id, *n, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if links else "", text))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row[:1]) + row[1:]


def same(df, want, with_groups=True):
    got = sorted((tuple(r) for r in df.select(*COLUMNS, *["groups"] * with_groups).collect()), key=key)
    assert got == sorted((w if with_groups else w[:-1] for w in want), key=key)


HARD = [(20, "<|endoftext|> <s> </s> <0x41> ▁"), (21, "plain <|endoftext|><s> <0x41>"), (22, "  two  spaces \n\n lines\n x\ty \r\n z"), (23, "ﬁ ① é ́ नमस्ते 👩‍👩‍👧 ꙮ"), (24, " "), (25, "\n"),
        (26, "don't we'll I'm 12345 --- !!! 　a b  c\x85d \x1c e"), (27, "a▁b c"), (28, "tail \n"), (29, "͸\U0001e030 new letters \U00031350"), (30, "a\x00b \x00")]


@pytest.mark.parametrize(("size", "work"), [(op.SLICE, op.WORK), (40, 7), (1, 1)])
def test_edge_rows(make_docs, tokenizers, size, work):
    docs = [(d, t) for d, t in EDGE if size > 1 or t is None or len(t) < 700] + HARD
    df = make_docs(docs, extra=("_piece", "n_a", "_key", "groups"))
    same(op.align(df, A, B, size, work, with_groups=True), walked(tokenizers, docs))


def test_long_documents_span_slices_pieces_and_tasks(make_docs, tokenizers):
    long = " ".join(f"Wörter{i % 977} und\nmore-{i % 31}" for i in range(60_000))
    docs = [(1, "short one"), (2, long), (3, "漢字" * 40_000), (4, long[:5000]), (5, long + " ▁")]
    want = walked(tokenizers, docs)
    assert want[-1][1] == 0
    same(op.align(make_docs(docs), A, B, 100_000, 10_000), want, with_groups=False)


def test_empty_table(make_docs):
    assert op.align(make_docs([]), A, B).collect() == []


def test_diagonals_give_the_plain_merge():
    rng = np.random.default_rng(1)
    for n, m, top in [(0, 5, 9), (7, 0, 9), (200, 150, 60), (1, 300, 5), (300, 300, 1000)]:
        a, b = np.sort(rng.integers(0, top, n)), np.sort(rng.integers(0, top, m))
        order = sorted([(int(x), 0) for x in a] + [(int(x), 1) for x in b])
        taken = np.concatenate([[0], np.cumsum([k == 0 for _, k in order])])
        assert op.diagonals(a, b, np.arange(n + m + 1)).tolist() == taken.tolist()


def test_pieces_are_equal_work(make_docs):
    docs = [(i, "some words " * (i % 7 * 40)) for i in range(30)] + [(99, "many words here " * 3000)]
    rows = op.pieces(make_docs(docs, parts=1), A, B, 20_000, 500).select("_a_upto", "_b_upto").collect()
    work = [r[0][-1] + r[1][-1] for r in rows]
    assert len(work) > 30 and max(work) <= 500
    assert sum(w >= 250 for w in work) > 0.8 * len(work)


def test_parts_are_forgotten_and_learnt_again(make_docs, tokenizers, monkeypatch):
    enc = op.Both(A, B)
    monkeypatch.setattr(op, "_KNOWN", 50)
    texts = [" ".join(f"w{i * 7 % 211}x{j}" for i in range(90)) for j in range(4)] * 2
    for t in texts:
        at = enc.find(enc.segment.findall(" " + t))
        assert enc.take(0, at).tolist() == tokenizers[0].encode(" " + t, add_special_tokens=False).ids
        assert enc.take(1, at).tolist() == tokenizers[1].encode(t)
        assert len(enc.place) <= 200


def test_query_against_plain_walk(spark, tokenizers):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same(op.op11_alignment(spark, "/root/testdata/sf0.001"), walked(tokenizers, docs), with_groups=False)
