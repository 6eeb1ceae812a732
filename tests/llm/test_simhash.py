"""Fingerprints and the search for near ones against brute force."""

import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from hertzlake.llm import simhash

SECOND = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)


def brute_print(text):
    votes, total = [0] * 128, 0
    for word in re.findall("[^\x20\x09-\x0d]+", text):
        letters = min(16, len(word))
        weight = 1 + letters * letters // 16
        total += weight
        both = xxhash.xxh64_intdigest(word.encode(), 42) << 64 | xxhash.xxh64_intdigest(word.encode(), SECOND)
        for k in range(128):
            votes[k] += weight * (both >> k & 1)
    return sum(1 << k for k in range(128) if 2 * votes[k] > total)


def brute_likeness(a, b):
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 128))


def brute_rows(rows):
    texts = sorted(((i, t or "") for i, t in rows if i is not None))
    follows = [(i, t, texts[(k + 1) % len(texts)][1]) for k, (i, t) in enumerate(texts)] + [(None, t or "", t or "") for i, t in rows if i is None]
    out = []
    for i, t, after in follows:
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        a, e = brute_print(t), brute_print(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:032x}", f"{e:032x}", round(brute_likeness(a, e), 9), round(brute_likeness(a, brute_print(after)), 9)))
    return sorted(out, key=str)


def found_rows(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 25)))
    texts = [None, "", " ", "\t\n", "one", "éé", "a\x0bb\rc d", "x" * 3000, " ".join(word() for _ in range(4000)), "same text " * 40, "same text " * 40, "\x85   wide blanks"]
    texts += ["\n".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    ids = rng.sample(range(-50, 10**12), len(texts))
    return [*zip(ids, texts), (ids[9], texts[9]), (ids[9], "another text of this id"), (ids[0], texts[0]), (None, "no id here"), (None, "no id here"), (None, None)]


@pytest.mark.parametrize("size", [60, 2000, 1 << 22])
def test_fingerprints_equal_brute_force(spark, monkeypatch, size):
    """Whatever the ranges."""
    monkeypatch.setattr(simhash, "RANGE_BYTES", size)
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, at int, range string").repartition(7)
    assert found_rows(simhash.edited_fingerprints(docs)) == brute_rows(rows)


def test_few_documents(spark):
    for rows in ([], [(3, "only one document")], [(None, "no id at all")], [(2, "b"), (1, "a")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found_rows(simhash.edited_fingerprints(docs)) == (brute_rows(rows) if any(i is not None for i, _ in rows) or rows else [])


def test_one_shuffle_and_no_python(spark, folder, capsys):
    simhash.edited_fingerprints(spark.read.parquet(f"{folder}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("radius", [5, 6, 7])
def test_near_fingerprints_equal_all_pairs(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(128) for _ in range(6)] + [0, (1 << 128) - 1]
    prints = [c ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(10))) for c in centres for _ in range(25)] + centres * 3
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1), 1) for x in prints]
    table = spark.createDataFrame(rows, "hi long, lo long, n long")
    found = {(r.hi, r.lo): r.n_near for r in simhash.near_fingerprints(table, table.filter("hi % 3 != 1"), radius).collect()}
    expected = {rows[k][:2]: sum((x ^ y).bit_count() <= radius for y in prints) for k, x in enumerate(prints) if (abs(rows[k][0]) % 3) * (1 if rows[k][0] >= 0 else -1) != 1}
    assert found == expected
    assert simhash.near_fingerprints(table.limit(0), table, radius).count() == 0
    with pytest.raises(ValueError):
        simhash.near_fingerprints(table, table, 8)


def test_search_equals_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, brute_print(r.text or "")) for r in docs.collect()]
    found = {r.doc_id: (r.fingerprint, r.n_near) for r in simhash.near_documents(docs, col("doc_id") % 20 == 0).collect()}
    assert found == {i: (f"{x:032x}", sum((x ^ y).bit_count() <= 6 for _, y in rows)) for i, x in rows if i % 20 == 0}


def test_equal_texts_have_equal_fingerprints_and_edits_stay_near(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = simhash.edited_fingerprints(docs)
    same = found.join(docs, "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert same.filter("n > 1").count() == 0
    assert found.filter("near_edited > near_next").count() > 0.97 * docs.count()
