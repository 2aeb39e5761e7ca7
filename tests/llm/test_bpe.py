import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from batchloom.llm import bpe
from batchloom.llm.queries import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.load_vocabulary(PATH)
ODD = [
    "", " ", "  a  b ", "a" * 3000, "ab" * 700, "don't 'S 're  x\n\n y\t", "<|endoftext|> x<|endoftext|><|endoftext|>",
    "a\x1cb\x1d \x85c d​e", "½²ⅷ 𝟙𝟚 日本語 😀😀 é", "\x00\x01", "�﻿", "'''''ll",
]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(text):
    packed = bpe.Encoder(VOCABULARY).packed([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == ids_of(text)
    assert bpe.decode_packed(packed, VOCABULARY) == text


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    check(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40))
def test_any_ids_decode(ids):
    packed = np.array(ids, dtype="<u4").tobytes()
    assert bpe.decode_packed(packed, VOCABULARY) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_columns(spark):
    """Nulls, repeated rows, clashing names and an empty table."""
    rows = [(1, None, 5), (2, "", 6), (3, "the cat's", None), (3, "the cat's", None), (None, "x" * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = bpe.decode(bpe.encode(df, "text", VOCABULARY), "ids", VOCABULARY)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, r.ids, r.decoded) for r in out.collect()), key=str)
    assert got == sorted(((r[0] or 0, ids_of(r[1] or ""), r[1] or "") for r in rows), key=str)
    assert bpe.encode(df.limit(0), "text", VOCABULARY).count() == 0
    assert bpe.round_trip(df, "doc_id", "text", VOCABULARY).where("same_text").count() == 5


def test_a_small_cache_changes_nothing(monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary(**vars(VOCABULARY) | {"words": {}}))
    texts = [f"word{i} other{i % 7} thing" for i in range(300)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    for i in range(0, 300, 30):
        for text, packed in zip(texts[i : i + 30], encoder.packed(texts[i : i + 30])):
            assert np.frombuffer(packed, "<u4").tolist() == ids_of(text)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = op1_bpe(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(ids_of(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.same_text
