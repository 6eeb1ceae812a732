import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hertzlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
ENCODER = bpe.TextEncoder(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab e\n'st!=-  é́漢0\x1c\x85 ſ"), max_size=60) | st.text(max_size=40).filter(lambda x: x.isprintable()))
def test_encodes_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abet =-\nés"), max_size=60), st.text(st.sampled_from("abet é"), max_size=10), st.data())
def test_appends_and_edits_equal_a_fresh_start(text, new, data):
    encoder, whole = ENCODER.encoder, text.encode()
    last = encoder.prefix_tokens(whole)
    grown, fresh = encoder.append(whole, last, new.encode())
    assert (grown, fresh) == (whole + new.encode(), encoder.prefix_tokens(whole + new.encode()))
    start = data.draw(st.integers(0, len(whole)))
    end = data.draw(st.integers(start, len(whole)))
    edited, fresh, _ = encoder.edit(whole, last, start, end, new.encode())
    assert fresh == encoder.prefix_tokens(edited)


def test_an_edit_of_a_long_text_is_local():
    rnd = random.Random(1)
    data = " ".join(rnd.choice(["the", "house", "of", "wonders", "Q"]) for _ in range(2000)).encode()
    last = ENCODER.encoder.prefix_tokens(data)
    edited, fresh, computed = ENCODER.encoder.edit(data, last, 5000, 5001, b"zz")
    assert computed < 1000 and fresh == ENCODER.encoder.prefix_tokens(edited)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect():
        assert row.ids == REFERENCE.encode_ordinary(texts[row.doc_id]) and bytes(row.decoded) == texts[row.doc_id].encode()


def test_cases(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a" * 300_000, "y"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = bpe.encoding_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(r.n_tokens for r in found)[:3] == [0, 0, 0] and len(found) == 4
    assert bpe.encoding_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "  \n  x", " a", "ab\x00c"])
def test_odd_texts(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)
