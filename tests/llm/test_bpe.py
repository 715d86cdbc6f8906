import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pointloom.llm import bpe, token_count, vocab

PATH = vocab.vocabulary_path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library_does_and_decodes_to_itself(text):
    text = text.encode("utf-8", "ignore").decode()
    library = Tokenizer.from_file(PATH) if not hasattr(bpe, "_library") else bpe._library
    bpe._library = library
    got = bpe.codec(PATH).encode(text)
    assert ids(got) == library.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).decode(got) == text
    assert token_count.counter(PATH).count(text) == len(ids(got))


def test_backtracking_equals_plain_merges_on_adversarial_pieces():
    encoder, plain = vocab.BacktrackingEncoder(PATH), vocab.load(PATH)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 9, 17, 33):
        for _ in range(60):
            piece = bytes(rng.choice(list(b"aeinrstho "), n))
            assert encoder.encode(piece) == plain.merge(piece)


def test_long_pieces_take_linear_time():
    codec = bpe.codec(PATH)
    assert codec.decode(codec.encode("ab" * 100_000)) == "ab" * 100_000


def test_whole_tokens_encode_alone_as_one(library):
    whole = vocab.whole_tokens(PATH)
    for token, i in list(whole.items())[::997]:
        text = token.decode("utf-8", "ignore")
        if text and text.encode() == token and len(bpe.codec(PATH).split.pieces(text)[0]) == 1:
            assert library.encode(text, add_special_tokens=False).ids == [i]


def test_broken_utf8_decodes_as_the_library_does(library):
    for i in (0xC3, 160, 5, 50256):
        data = struct.pack("<2I", i, 64)
        assert bpe.codec(PATH).decode(data) == library.decode([i, 64], skip_special_tokens=False)


def test_rows_and_digests(spark, edge_docs, library):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.op1(edge_docs).collect()}
    want = edge_docs.collect()
    assert len(bpe.op1(edge_docs).collect()) == len(want)
    for r in want:
        expected = library.encode(r.text or "", add_special_tokens=False).ids
        row = got[r.doc_id, len(expected)]
        assert row.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        text = library.decode(expected, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode_frames(edge_docs):
    back = bpe.decode(bpe.encode(edge_docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in edge_docs.collect())


def test_empty_tables(no_docs):
    assert bpe.op1(no_docs).count() == 0 and token_count.op10(no_docs).count() == 0


def test_token_counts(edge_docs, library):
    for r in edge_docs.join(token_count.op10(edge_docs).withColumnRenamed("n_tokens", "c").distinct(), "doc_id").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.c, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)


def test_whole_table_against_the_library(small, library):
    texts = {r.doc_id: r.text for r in small.collect()}
    want = {i: len(e.ids) for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in token_count.op10(small).collect()} == want
    assert {r.doc_id: r.n_tokens for r in bpe.op1(small).collect()} == want
