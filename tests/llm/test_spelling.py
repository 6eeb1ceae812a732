"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from hertzlake.llm import spelling


def brute_near(a, b):
    """By all strings that one edit makes of a."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(counts):
    near = {w: [v for v in counts if brute_near(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def brute_words(rows, damage):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def found_of(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def mixed_words(seed, size):
    rng = random.Random(seed)
    letters = "abé"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(size)}
    return {w: rng.choice((1, 2, 3, 4, 8, 16, 33)) for w in words} | {"aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "aaaaaaaa": 40}


def test_pairs_of_words():
    rng = random.Random(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(2))
        assert spelling.one_edit_apart(a, b) == brute_near(a, b) and not spelling.one_edit_apart(a, a)


def test_lists_by_a_heap():
    rng = random.Random(3)
    for _ in range(500):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 20))) for _ in range(rng.randrange(1, 9))]
        counts = Counter(x for own in lists for x in own)
        for least in range(1, len(lists) + 1):
            assert list(spelling.in_lists(lists, least)) == sorted(x for x, n in counts.items() if n >= least)


@pytest.mark.parametrize("block", [3, 4096])
def test_groups_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    counts = mixed_words(7, 700)
    rows = [(w, n, "x") for w, n in counts.items()]
    assert found_of(spelling.variant_groups(spark.createDataFrame(rows, "word string, n long, near string").repartition(5))) == brute_groups(counts)


def test_long_words_and_a_frequent_one(spark):
    long = "wörter" * 3000
    counts = {long: 3, long[:-1]: 9, long + "x": 30, **{f"{chr(97 + k)}{chr(97 + j)}mmon": 3 for k in range(26) for j in range(3)}, "ommon": 500}
    rows = [(w, n) for w, n in counts.items()] + [(None, 4), ("abc", 9)]
    assert found_of(spelling.variant_groups(spark.createDataFrame(rows, "word string, n long"))) == brute_groups(counts)


def test_odd_documents(spark):
    texts = [None, "", "1 2 3", "ÉCOLE école École", "Straße×÷Straße straße", "letters letter lettrs letters", "ab " * 50, "x" * 9000, "lettersletters " * 9]
    rows = [(k, t, "w", k) for k, t in enumerate(texts)] + [(40, "received recieved received", None, None)] * 4 + [(None, "letters " * 8, "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long").repartition(3)
    for damage in (2, 97):
        assert found_of(spelling.spelling_variants(docs, damage=damage)) == brute_groups(brute_words([r[:2] for r in rows], damage))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
