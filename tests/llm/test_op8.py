"""Packed ids: exact round trips, the library's own ids, starts in order."""
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import EDGE
from scanforge.llm import op8_packed_ids as o
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


class Handle(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 32])
def test_pack_and_random_access(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 700, 0, 63, 64, 65, 1000)]
    f = Handle()
    w = o.PackedWriter(f, bits, block_ids=64)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i * 10, d)
    w.close()
    r = o.PackedReader(f)
    assert r.sizes.tolist() == [len(d) for d in docs] and r.docs.tolist()[1:] == [10 * i for i in range(1, len(docs))]
    assert all((r.document(i) == d).all() for i, d in enumerate(docs))
    flat = np.concatenate(docs)
    for a, b in ((0, 0), (3, 9), (60, 200), (0, len(flat)), (len(flat) - 1, len(flat))):
        assert (r.ids(a, b) == flat[a:b]).all()
    assert r.offsets[-1] == sum(-(-min(64, len(flat) - k) * bits // 8) for k in range(0, len(flat), 64))


def test_word_by_word_is_the_whole_text():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = [x or "" for _, x in EDGE] + ["It's we'll  DON'T\t<|endoftext|>x <|startoftext|> ΑΣ Σ ẞ", "é ̈x K", "a\xa0b　c\x85d\x1cq", "1st 22nd ½ ²"]
    texts += ["".join(chr(rng.choice([32, 10, 39, *range(65, 123), 0x301, 0xE9, 0x4E2D, 0x1F600])) for _ in range(200)) for _ in range(60)]
    for x, ids in zip(texts, o.WordEncoder(PATH).encode([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x[:50]


def test_query(sf, spark):
    rng = random.Random(3)
    rows = EDGE + [(i, " ".join(rng.choice(["Some", "words", "été", "x9"]) for _ in range(rng.randint(0, 80)))) for i in range(100, 300)]
    rng.shuffle(rows)
    t = Tokenizer.from_file(PATH)
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]
    got = sorted([tuple(r) for r in o.op8_packed_ids(spark, sf(rows)).collect()], key=lambda r: r[1])
    assert sorted((str(d), n, crc) for d, _, n, crc in got) == sorted((str(d), len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())) for d, x in rows)
    order = [d for d, *_ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert o.op8_packed_ids(spark, sf([], "none")).count() == 0


def test_files_are_read_back_by_several_tasks(make_docs, spark, tmp_path):
    rows = [(i, f"some words of text {i}") for i in range(400)]
    manifest = o.write_packed(make_docs(rows), str(tmp_path / "packed"), PATH)
    digests = o.read_digests(manifest, str(tmp_path / "packed"))
    assert digests.count() == 400 and digests.rdd.getNumPartitions() == manifest.count()
    many = spark.createDataFrame([(k, f"{tmp_path}/none{k}", 7 * k) for k in range(40)], "part bigint, path string, start bigint")
    assert o.read_digests(many, str(tmp_path)).rdd.getNumPartitions() == 40  # not read: only the partitions are counted
