import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no vocabulary files")
PIECE = st.sampled_from(["a", "b", " ", "  ", "\n", "'l", "l", "'re", "9", "!", "ü", " x", "　", "é", "👍", "<|endoftext|>"])


def chunked(text):
    begin, out = 0, []
    for end in tokens.cuts(text):
        out.append(text[begin:end])
        begin = end
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, max_size=400))
def test_repaired_joins_equal_whole_encoding(pieces):
    text = "".join(pieces)
    least, bits = tokens.LEAST, tokens.MASK_BITS
    tokens.LEAST, tokens.MASK_BITS = 4, 2
    try:
        parts = chunked(text)
        assert "".join(parts) == text
        got = tokens.join_chunks(text, tokens.cuts(text), [tokens.encode_whole([p])[0] for p in parts], tokens.encode_whole)
    finally:
        tokens.LEAST, tokens.MASK_BITS = least, bits
    assert got == tokens.encode_whole([text])[0]


@pytest.mark.parametrize("unit", ["a", " ", "ab ", "'ll", "\n \t", "ü", "1", "!?"])
def test_long_runs(unit):
    text = unit * 20_000
    parts = chunked(text)
    assert tokens.join_chunks(text, tokens.cuts(text), [tokens.encode_whole([p])[0] for p in parts], tokens.encode_whole) == tokens.encode_whole([text])[0]


def test_copied_passages_give_equal_chunks():
    draw = random.Random(3)
    shared = "".join(draw.choice("abcdefgh ") for _ in range(20_000))
    a, b = chunked("first " + shared), chunked("another beginning " + shared)
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_corpus(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, " \n "), (5, "word " * 5000), (6, "word " * 5000), (7, "<|endoftext|>")]
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as hash")).collect()}
    assert got == {k: tokens.encode_whole([t])[0] if t else [] for k, t in rows}
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(1, "first text " * 50), (1, "another one " * 70), (None, "no id " * 40), (2, "twice"), (2, "twice")]
    got = sorted((str(r.doc_id), r.ids) for r in tokens.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted((str(k), tokens.encode_whole([t])[0]) for k, t in rows)
