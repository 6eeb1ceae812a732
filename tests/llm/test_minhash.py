import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzlake.llm import common, minhash
from hertzlake.llm.components import connected_components
from hertzlake.storage import Scratch


def words_of(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")


def brute(rows):
    """component and set size by position; rows with one id are one document."""
    sets = []
    for _, text in rows:
        words = [w for w in words_of(text) if w]
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared) or rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]:
                group[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[k]:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted((str(d), len(sets[k]), str(least[find(k)] if d is not None and sets[k] else d)) for k, (d, _) in enumerate(rows))


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    found = minhash.near_duplicates(docs).collect()
    assert all(r.kept == (r.component_id == r.doc_id) for r in found)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)


def edited(words, rnd, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [10**6, 0])
def test_equals_brute_force_on_groups_and_chains(spark, monkeypatch, small):
    monkeypatch.setattr(common.if_small, "__defaults__", (small,))
    monkeypatch.setattr(minhash, "GROUP", 3 if small else 64)
    rnd = random.Random(7)
    rows = []
    base = [f"a{rnd.randrange(500)}" for _ in range(150)]
    rows += [(k, edited(base, rnd, rnd.randrange(9))) for k in range(150)]  # one bucket's many members, not all linked
    chain = [f"c{k}" for k in range(400)]
    rows += [(200 + k, " ".join(chain[20 * k : 20 * k + 160])) for k in range(10)]  # linked with the next one only
    rows += [(300 + k, edited([f"b{k // 4}-{j}" for j in range(90)], rnd, 2)) for k in range(40)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "One two"), (404, "one  TWO\n"), (405, "É two"), (406, "é two"), (500, "x y z " * 40_000), (501, "x y z " * 40_000)]
    rows += [(7, "quite another text of some seven words"), (None, rows[0][1]), (None, None), (403, "One two")]
    assert result(spark, rows) == brute(rows)


def test_equals_brute_force_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    assert result(spark, rows) == brute(rows)


def test_rows_with_one_id_are_one_document(spark):
    rnd = random.Random(11)
    base = [[f"s{k}-{rnd.randrange(10**6)}" for _ in range(120)] for k in range(4)]
    rows = [(1, " ".join(base[0])), (5, " ".join(base[0])), (5, " ".join(base[1])), (8, edited(base[1], rnd, 1)), (9, " ".join(base[2])), (9, " ".join(base[3]))]
    rows += [(10 + k, edited(base[2 + k % 2], rnd, 1)) for k in range(6)] + [(5, None), (30, "alone"), (None, " ".join(base[3]))]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rnd = np.random.default_rng(3)
    kept = 0
    for _ in range(300):
        whole = rnd.integers(1, 2**63, 350, dtype=np.uint64)
        one, other = np.unique(whole[:300]), np.unique(whole[50:])  # 250 / 350 is below, 250 / 330 above the threshold
        close = np.unique(np.append(whole[50:300], rnd.integers(1, 2**63, 30, dtype=np.uint64)))
        assert not minhash.linked(one, other) and minhash.linked(one, close)
        kept += len(minhash.survivors(minhash.signature(one)[None], minhash.signature(close)[None]))
    assert kept == 300
    far = [minhash.signature(rnd.integers(1, 2**63, 200, dtype=np.uint64))[None] for _ in range(2)]
    assert len(minhash.survivors(*far)) == 0


def test_components(spark):
    rnd = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(50)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    scratch = Scratch(spark)
    found = connected_components(spark.createDataFrame(links, "a long, b long"), scratch)
    least = found.groupBy("root").agg(F.min("id").alias("least"))
    got = {r.id: r.least for r in found.join(least, "root").collect()}
    group = {}
    for a, b in links:
        if a is not None and a != b:
            merged = group.get(a, {a}) | group.get(b, {b})
            group.update({x: merged for x in merged})
    for x, members in group.items():
        assert got[x] == min(members)
    assert set(got) == set(group) and connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    scratch.clear(found)
    assert found.count() == len(got) and [table for table, _ in scratch.tables] == [found]


def test_sketches_prune_nothing_that_signatures_keep():
    rnd = np.random.default_rng(5)
    one = rnd.integers(0, 2**32, (500, minhash.HASHES), dtype=np.uint32)
    other = np.where(rnd.random((500, 1)) > rnd.random((500, minhash.HASHES)), one, rnd.integers(0, 2**32, one.shape, dtype=np.uint32))
    kept = set(minhash.survivors(one, other))
    assert kept and kept <= set(minhash.survivors(one.astype(np.uint8), other.astype(np.uint8)))
    assert (minhash.band_keys(one) % minhash.BANDS == np.arange(minhash.BANDS)).all()
