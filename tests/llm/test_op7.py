"""SentencePiece against the library, parts against the whole, round trips."""
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from conftest_llm import EDGE
from scanforge.llm import op7_lattice as l
from scanforge.llm import op7_sentencepiece as o

MODEL = o.model_path()
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(1)
    out = [t or "" for _, t in EDGE] + ["a▁b", "▁", "1234567890" * 9, "\0 zero", "\x85 　x", "  two  spaces "]
    out += ["".join(rng.choice("abnsthe 漢\n") for _ in range(rng.randint(1, 900))) for _ in range(40)]
    out += ["".join(rng.choice("aaaaeinst") for _ in range(n)) for n in (127, 128, 255, 256, 257, 300, 511, 512, 513, 3000)]
    return out + ["a" * n for n in (250, 257, 1000)] + ["the" * 400, "=-" * 700, "." * 900, "漢字" * 300]


def test_ids_are_the_library_s():
    e = o.Encoder(MODEL)
    for t, ids in zip(texts(), e.texts(texts()), strict=True):
        assert ids.tolist() == LIB.encode(t), t[:40]
        assert o.decode_ids(e.lattice, ids) == LIB.decode(ids.tolist())


@pytest.mark.parametrize("part", [200, 777])
def test_parts_give_the_whole(part):
    e = o.Encoder(MODEL)
    for t in texts():
        if len(t) < part + 100:
            continue
        pieces = o.cut(e.lattice, e.marked(t), part, 20)
        assert "".join(p[0] for p in pieces) == e.marked(t) and len(pieces) > 1
        parts = [o.Part(e, *p) for p in pieces]
        states = l.states_through([p.matrix() for p in parts])
        assert [i for p, a, b in zip(parts, states, states[1:], strict=False) for i in p.ids(a, b)] == LIB.encode(t)


def test_combination_is_associative():
    e = o.Encoder(MODEL)
    chain = l.Chain(e.lattice, l.MARK + "thetionsanandered" * 60, [l.BEGIN])
    a, b, c = chain.matrices[1:4]
    assert l.combine(l.combine(a, b), c) == l.combine(a, l.combine(b, c)) != {}


def test_unigram_path_is_the_best_one():
    """The same lattice with scores as weights, against all segmentations."""
    lat = l.Lattice(MODEL)
    lat.bpe = False
    ids = {p: i for i, p in enumerate(lat.pieces)}

    def best(s):
        v = [0.0] + [l.NEVER] * len(s)
        for i in range(1, len(s) + 1):
            for k in range(max(0, i - lat.width), i):
                p = s[k:i]
                w = lat.score[ids[p]] if p in ids and p in lat_pieces else lat.score[lat.unk] if i - k == 1 else l.NEVER
                v[i] = max(v[i], v[k] + w)
        return v[-1]

    lat_pieces = {p for p, i in ids.items() if lat.length[i] == len(p) and not p.startswith("<")}
    for s in ["▁thetion", "▁abc漢def", "▁hello▁world" * 2]:
        paths = lat.paths([(s, len(s), 0, -1)])
        path = paths.path(0, len(s))
        assert sum(lat.score[t] for t in path) == pytest.approx(best(s)) == paths.value[paths.slot[0] + len(s)]
    s = "thetionsanand" * 40
    chain = l.Chain(lat, s, [l.BEGIN])
    states = l.states_through(chain.matrices)
    assert chain.matrix()[l.BEGIN][states[-1]] == pytest.approx(best(s))


def test_documents(make_docs, sf, spark):
    rng = random.Random(5)
    giants = [(900, "word and more " * 4000), (901, "".join(rng.choice("abthe ") for _ in range(50_000))), (902, "thetionand" * 5000), (901, "z " * 20_000)]
    rows = [(100 + i, t) for i, t in enumerate(texts())] + EDGE + giants + giants[:1] + [(None, "giant null " * 4000)]
    out = o.encode(make_docs(rows, extra=("ids", "_row", "core")), MODEL)
    want = sorted([(str(d), LIB.encode(t or "")) for d, t in rows])
    got = out.collect()
    assert sorted([(str(r.doc_id), r.ids) for r in got]) == want and all(r.n_tokens == len(r.ids) for r in got)
    assert max(r.n_parts for r in got) > 2
    back = o.decode(out, MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), LIB.decode(LIB.encode(t or ""))) for d, t in rows)
    digest = o.op7_sentencepiece(spark, sf(rows)).collect()
    crc = lambda t: zlib.crc32(np.array(LIB.encode(t or ""), "<i4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in digest) == sorted((str(d), crc(t)) for d, t in rows)
    assert all(r.round_trip for r in digest if r.doc_id not in {100 + i for i, t in enumerate(texts()) if "▁" in t})
    assert {r.decoded_sha256 for r in digest if r.doc_id == 900} == {hashlib.sha256(giants[0][1].encode()).hexdigest()}
    assert o.op7_sentencepiece(spark, sf([], "none")).count() == 0


def test_segments_of_the_older_generation_are_kept(monkeypatch):
    from scanforge.llm import op7_sentencepiece as op
    monkeypatch.setattr(op, "_MAX_CACHED", 20)
    encoder, model = op.Encoder(op.model_path()), __import__("sentencepiece").SentencePieceProcessor(model_file=op.model_path())
    for k in range(30):
        texts = [f"stays here word{k} and new{k}x{j}" for j in range(8)]
        assert [x.tolist() for x in encoder.texts(texts)] == model.encode(texts)
        assert len(encoder.cache) <= 20 and (k < 3 or encoder.older)
