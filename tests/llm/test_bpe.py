import hashlib
import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallgrass.llm import op7_bpe
from tallgrass.llm.bpe import NONE, WIDEST, Bpe, Forest, SegmentTree


@pytest.fixture(scope="module")
def both():
    path = op7_bpe.default_vocabulary()
    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), Bpe(f.read(), cache=500)


def agree(both, text):
    library, own = both
    ids = library.encode(text, add_special_tokens=False).ids
    raw, decoded = own.encode_both(text)
    assert own.encode(text) == ids, text
    assert decoded == library.decode(ids, skip_special_tokens=False), text
    assert own.decode(ids) == decoded


HARD = ["", " ", "\n\t ", "a", "it's I'LL we've don't 'S", "ÉCOLE École école", "ΣΊΣΥΦΟΣ ΣΑΣ", "İstanbul", "1234 ½ ² ٣٤ Ⅷ", "日本語テキスト", "😀😃 x😀y", "a\x00b \x85c  d \x1ce", "<|endoftext|>", "x<|startoftext|> y<|endoftext|>z <|END|>", "aaaa" * 3000, "loooong " + "ab" * 2000, "!!??...---", "ﬁ ǅ ß ẞ", "क्षि"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(both, text):
    agree(both, text)


def test_random_texts(both):
    rng = random.Random(5)
    pools = ["abcdefghij", "the and of ing ", "éèçñüß ÀÉ", "0123456789.,:;'\"!?", " \n\t ", "ΑΒΓΣσς", "日本語", "😀🎉́‍"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        agree(both, text)


def test_segment_tree():
    rng = random.Random(1)
    values = [rng.randint(0, 99) for _ in range(13)]
    tree = SegmentTree(list(values))
    for _ in range(300):
        i = rng.randrange(13)
        values[i] = rng.choice([rng.randint(0, 99), NONE])
        tree.put(i, values[i])
        assert tree.root() == min(values)


def test_words_of_a_slice_are_merged_together(both, monkeypatch):
    library, own = both
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("etaoinshréß日!7") for _ in range(rng.randint(1, 40))) for _ in range(200)) for _ in range(20)] + HARD
    texts += ["<|endoftext|>".join(texts[:2]), texts[3]]
    trees = []
    monkeypatch.setattr(SegmentTree, "__init__", lambda self, values, make=SegmentTree.__init__: trees.append(len(values)) or make(self, values))
    own.words.clear()
    got = list(own.encode_all(texts))
    # a tree of its own for long words only, whatever the cache holds
    assert trees and min(trees) + 1 > WIDEST // 4 and len(trees) < 900
    for text, (raw, decoded) in zip(texts, got, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert raw == struct.pack(f"<{len(ids)}I", *ids) and decoded == library.decode(ids, skip_special_tokens=False), text
    assert own.used <= own.cache


def test_forest_is_a_tree_for_each_row():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 99, (7, 8))
    forest = Forest(values)
    for _ in range(100):
        rows = np.flatnonzero(rng.random(7) < 0.5)
        at = rng.integers(0, 8, len(rows))
        values[rows, at] = new = rng.choice([5, 50, NONE], len(rows))
        forest.put(rows, at, new)
        assert (forest.roots(np.arange(7)) == values.min(axis=1)).all()


def test_query(spark, tmp_path, both):
    rows = [(1, "Hello world", 5), (2, None, 1), (None, "x", 2), (3, "", 0), (3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7_bpe.op7_bpe(spark, str(tmp_path)).collect()}

    def want(i, text):
        ids = both[0].encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(both[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert got == {want(i, t) for i, t, _ in rows}
    encoded = op7_bpe.encode_documents(docs)
    assert encoded.columns == ["doc_id", "text", "token_ids", "decoded"]
    for r in encoded.collect():
        assert r.token_ids == both[0].encode(r.text or "", add_special_tokens=False).ids
    assert {(r.doc_id, r.decoded) for r in op7_bpe.decode_documents(encoded).collect()} == {(r.doc_id, r.decoded) for r in encoded.collect()}
    assert op7_bpe.token_digests(docs.limit(0)).count() == 0
