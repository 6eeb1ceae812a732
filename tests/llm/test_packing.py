import itertools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hertzlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = packing.WordEncoder(PATH)


def fewest(items, capacity):
    best = [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for at in {room: b for b, room in enumerate(rooms) if room >= items[k]}.values():
            go(k + 1, [r - items[k] * (b == at) for b, r in enumerate(rooms)])
        go(k + 1, [*rooms, capacity - items[k]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_plans(case):
    capacity, items = case
    counts = np.bincount(items, minlength=capacity + 1)
    plan, got = packing.plan_packing(counts, capacity), np.zeros(capacity + 1, int)
    for pattern, times in plan.patterns:
        assert times > 0 and sum(length * copies for length, copies in pattern) <= capacity
        for length, copies in pattern:
            got[length] += copies * times
    assert (got == counts).all()
    best = fewest(items, capacity)
    assert packing.lower_bound(counts, capacity) <= best <= plan.sequences()
    left, fixed = counts.copy(), packing.Plan()
    packing.reduce_instance(left, capacity, fixed)  # never costs a sequence
    assert fixed.sequences() + fewest(list(itertools.chain(*([n] * int(left[n]) for n in range(capacity + 1)))), capacity) == best


SIGNS = ["a", "B", "é", "É", "İ", "I", "̇", "ß", "'s", "'T", ".", ",", "!", " ", "\n", " ", "—", "1", "9", "ſ", "漢", "\x1c", "\x85", "ŉ", "ª", "̸", "<", "&", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "#"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join))
def test_word_cache_encodes_as_the_library(text):
    assert ENCODER.encode(text) == ENCODER.whole(text.encode())


def checked(docs, found, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = {}
    for row in found:
        pieces.setdefault(row.doc_id, []).append(row)
    for doc_id, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(k, k * capacity) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    sequences = {}
    for row in found:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= capacity
    counts = np.bincount([r.length for r in found], minlength=capacity + 1)
    assert len(sequences) <= packing.lower_bound(counts, capacity) + 1


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    checked({r.doc_id: r.text for r in docs.collect()}, packing.pack(docs, PATH).collect(), packing.CAPACITY)


def test_small_sequences_and_cases(spark):
    rows = [(k, "the house of wonders " * (k % 9), "x") for k in range(60)] + [(100, None, "x"), (101, "word " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    checked({r[0]: r[1] for r in rows}, packing.pack(docs, PATH, capacity=64).collect(), 64)
    twice = docs.limit(5).union(docs.limit(5))
    assert packing.pack(twice, PATH).count() == 10 and packing.pack(docs.limit(0), PATH).count() == 0


def test_another_tokenizer_encodes_by_the_library():
    other = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert ENCODER.known and not other.known
    text = "The House, of wonders'll  stand\n\n"
    ids = other.tokenizer.encode(text, add_special_tokens=False).ids
    assert other.encode(text) == np.array(ids, "<u4").tobytes()


def test_long_strings_are_not_kept():
    encoder = packing.WordEncoder(PATH)
    for text in ("x" * 5000, "Y" * 100 + "!" * 200, "." * 300, "Ab" * 40 + "."):
        assert encoder.encode(text) == encoder.whole(text.encode())
    assert all(len(x) <= packing.CACHED_BYTES for x in encoder.cache)


def test_many_pieces_of_a_length_are_split(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 7)
    rows = [(k, "the house of wonders " * (k % 3)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    checked(dict(rows), packing.pack(docs, PATH, capacity=64).collect(), 64)
