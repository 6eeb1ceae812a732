import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzlake.llm import embedjoin
from hertzlake.storage import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"


def brute(rows, cosine=0.98):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None and k is not None for k, v, label in rows]
    links, group = [0] * n, list(range(n))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    group[find(a)] = find(b)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return sorted((str(rows[k][0]), links[k], str(least[find(k)] if rows[k][0] is not None else None)) for k in range(n))


def result(spark, rows):
    found = embedjoin.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert all(r.kept == (r.component_id == r.vec_id) for r in found)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found)


@pytest.mark.parametrize("block,leaf,fan,group", [(2048, 64, 32, 16), (16, 4, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, block, leaf, fan, group):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("FAN", fan), ("GROUP", group)):
        monkeypatch.setattr(embedjoin, name, value)
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        base = rng.normal(size=12)
        rows += [((base + rng.normal(size=12) * rng.choice([0.02, 0.1, 0.3, 2])) * rng.choice([1, 5]), label) for _ in range(120)]
    rows += [(rows[0][0], 0)] * 5 + [(-rows[0][0], 0), (rows[0][0][:5], 0), (rows[0][0][:5], 0), (rows[0][0], None)]
    rows = [(k, v.tolist(), label) for k, (v, label) in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 12, [nan] + [1.0] * 11, [inf] * 12, [None] + [1.0] * 11, [1e-30] * 12, [1e30] * 12]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(1100, None, None), (None, rows[0][1], 0)]
    assert result(spark, rows) == brute(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (2, [1.0, 0.01], 3), (3, [0.0, 1.0], 3)]
    assert result(spark, rows) == brute(rows)
    assert embedjoin.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert result(spark, [(1, None, 1)]) == [("1", 0, "1")]


def test_one_id_of_different_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)]
    assert result(spark, rows) == brute(rows) == [("1", 0, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 0, "3")]


def test_distant_blocks_are_skipped(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("FAN", 4)):
        monkeypatch.setattr(embedjoin, name, value)
    # a half circle of vectors, far more than epsilon long
    rows = [(k, [float(np.cos(k / 400 * np.pi)), float(np.sin(k / 400 * np.pi))], 1) for k in range(400)]
    scratch = Scratch(spark)
    vectors = embedjoin._keyed(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).withColumn("cid", F.col("vec_id"))
    placed = embedjoin._placed(vectors, embedjoin.principal_axes(vectors), 0.2)
    blocks, total = embedjoin._numbered(embedjoin._blocks(placed, scratch))
    pairs = [tuple(r) for r in embedjoin._block_pairs(blocks, total, 0.2, scratch).collect()]
    assert total >= 50 and len(pairs) == len(set(pairs)) < total * (total + 1) / 4
    assert sorted(r.block for r in blocks.collect()) == list(range(total))
    assert result(spark, rows) == brute(rows)


def test_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(spark, rows) == brute(rows)
