import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_store as S

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids(tok, t):
    return [*tok.encode(t or "", add_special_tokens=False).ids, 2]


def test_read_back_against_the_library(spark, docs, rows, tok):
    path = S.store(docs, PATH, shard_tokens=500, partitions=5)
    got = S.documents(spark, path).collect()
    have = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    key = lambda i: -10**9 if i is None else i
    assert [key(h[1]) for h in have] == sorted(key(r[0]) for r in rows)
    start = 0
    for s, _, n, _ in have:
        assert s == start
        start += n
    want = sorted(((key(r[0]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows for x in [ids(tok, r[1])]), key=repr)
    assert sorted(((key(h[1]), h[2], h[3]) for h in have), key=repr) == want
    stream = [x for r in sorted(rows, key=lambda r: key(r[0])) for x in ids(tok, r[1])]
    assert len(stream) == start
    for t in (2, 262, stream[7], 50256):
        assert sum(r.n for r in S.count_token(spark, path, t).collect()) == stream.count(t)
        assert sorted(r.position for r in S.find_token(spark, path, t).collect()) == [i for i, x in enumerate(stream) if x == t]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r'stremd.,#19aAéßÉ×÷²ªºµ\x0b\x1f\xa0 ʰ中«—"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_is_the_library(text):
    assert S.encoder(PATH)([text])[0].tolist() == S.encoder(PATH).tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abé.,'s\n 1 "), max_size=20), max_size=12))
def test_batches_and_forgetting(texts):
    """Pieces learned from one text serve the others, also after the memo starts anew."""
    e = S.Encoder(PATH)
    want = [e.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e(texts)] == want
    e.memo.n = S.MEMO + 1
    assert [x.tolist() for x in e(texts)] == want


def test_added_token_in_text(tok):
    t = "a <|endoftext|> b"
    assert S.encoder(PATH)([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
    assert 50256 in tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(0, 10**6))
def test_wavelet_matrix(values, pick):
    w = S.WaveletMatrix.build(np.array(values, np.uint32), 9)
    assert w.tokens().tolist() == values
    if values:
        i = pick % len(values)
        t = values[i]
        assert w.access(i) == t
        assert w.rank(t, i) == values[:i].count(t) and w.count(t) == values.count(t)
        assert w.select(t, values[:i].count(t)) == i
    absent = 400
    assert w.count(absent) == 0 and w.count(2**12) == 0
    with pytest.raises(IndexError):
        w.select(absent, 0)


def test_wide_ids():
    x = np.random.default_rng(0).integers(0, 2**20, 3000).astype(np.uint32)
    w = S.WaveletMatrix.build(x, 20)
    assert (w.tokens() == x).all() and w.access(2999) == x[2999]


def test_empty(spark, empty):
    assert S.documents(spark, S.store(empty, PATH)).count() == 0
