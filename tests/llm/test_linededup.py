import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hertzlake.llm import linededup


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})


def brute(texts, least):
    lines = [(text or "").split("\n") for text in texts]
    counts = Counter(k for own in lines for k in {key(x) for x in own} if k)
    kept = [[x for x in own if counts[key(x)] < least] for own in lines]
    return [(len(own), len(own) - len(stay), "\n".join(stay)) for own, stay in zip(lines, kept)]


@pytest.mark.parametrize("most", [linededup.MOST_BROADCAST, 0])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(linededup, "MOST_BROADCAST", most)
    rnd = random.Random(4)
    pool = ["Share this", " share THIS\t", "É", "é", "", " ", "rare one", "a", "A\r", "Ünique "]
    texts = ["\n".join(rnd.choice([*pool, f"own {k}"]) for _ in range(rnd.randrange(8))) for k in range(80)] + [None, "", "x\n" * 30_000]
    rows = [(k // 2 if k < 20 else k, text, k) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lost long")
    for least in (2, 10):
        expected = Counter((row[0], *x) for row, x in zip(rows, brute(texts, least)))
        assert Counter(map(tuple, linededup.dedup_lines(docs, least).collect())) == expected
        digests = linededup.dropped_lines_digests(docs, least)
        digest = lambda x: (*x[:2], hashlib.sha256(x[2].encode()).hexdigest())
        assert Counter(map(tuple, digests.collect())) == Counter((row[0], *digest(x)) for row, x in zip(rows, brute(texts, least)))
        documents = linededup.dedup_documents(docs, least)
        assert documents.columns == docs.columns
        assert Counter((r.lost, r.text) for r in documents.collect()) == Counter((row[2], x[2]) for row, x in zip(rows, brute(texts, least)))
    assert linededup.dedup_lines(docs.limit(0)).count() == 0 and linededup.dedup_lines(docs.limit(3)).count() == 3


def test_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, fan_out=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, f"all\nown {k}\n\n{'pair' if k < 2 else ''}")], "doc_id long, text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert Counter(r.n for r in runs.counts().collect()) == Counter({5: 1, 2: 1, 1: 5})
    fresh = runs.unseen(spark.createDataFrame([(9, "ALL \nnew\nown 3")], "doc_id long, text string")).collect()
    assert [(r.pos, r.line) for r in fresh] == [(1, "new")]


def test_frequent_lines_are_not_added_again(spark):
    runs = linededup.LineRuns(spark, least_docs=2, fan_out=9)
    for k in range(4):
        runs.add(spark.createDataFrame([(2 * k, "all\nsame"), (2 * k + 1, f"ALL\nown {k}")], "doc_id long, text string"))
    sizes = [runs._read([name]).count() for name in runs.levels[0]]
    assert sizes == [3, 2, 1, 1]  # all is frequent from the first batch on, same from the second
    assert runs.frequent().count() == 2
    docs = spark.createDataFrame([(k, "all\nsame") for k in range(40)], "doc_id long, text string")
    assert linededup.count_lines(docs, least_docs=10).frequent().count() == 2


def test_runs_meet_without_a_shuffle(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k, f"all\nown {k}") for k in range(40)], "doc_id long, text string")
        runs = linededup.count_lines(docs)
        runs._read(runs._names()).join(runs.frequent().hint("merge"), ["h1", "h2"], "left_anti").explain()
        plan = capsys.readouterr().out
        assert "Exchange" not in plan and "SortMergeJoin" in plan and [len(x) for x in runs.levels] == [1, 1]
        runs.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_are_counted_one_by_one_and_compacted(spark, monkeypatch):
    """No count is over more than a batch; the runs alone add up what a line has in several."""
    monkeypatch.setattr(linededup, "BUCKET_BYTES", 500)
    rnd, seen, counted = random.Random(3), [], linededup._counted
    docs = spark.createDataFrame([(k, "\n".join(f"line {rnd.randrange(60)}" for _ in range(9))) for k in range(200)], "doc_id long, text string")

    def one(lines):
        counts = counted(lines)
        seen.append(sum(r.n for r in counts.collect()))
        return counts

    monkeypatch.setattr(linededup, "_counted", one)
    runs = linededup.count_lines(docs, least_docs=10**6)
    distinct = sum(len(set(r.text.split("\n"))) for r in docs.collect())
    assert len(seen) == 4 and sum(seen) == distinct and all(0.1 * distinct < n < 0.5 * distinct for n in seen)
    assert [len(level) for level in runs.levels] == [1, 1] and runs.buckets > 1  # three were compacted
    assert sum(r.n for r in runs.counts().collect()) == distinct
    assert 1 < len(runs._read(runs.levels[1]).inputFiles()) <= runs.buckets
    runs.drop()


def test_lines_in_the_table_of_a_task():
    rng = np.random.default_rng(1)
    lines = [b"Line %d " % k for k in range(3000)]
    known = {x.strip().lower() for x in lines[::3]}
    hashes = [(linededup._first_hash(x), linededup.xxhash.xxh64_intdigest(x, linededup._SECOND)) for x in known]
    # another line with the same first hash
    hashes += [(h1, 7) for h1, _ in hashes[:50]] + [(linededup._first_hash(lines[1].strip().lower()), 9)]
    h1, h2 = (np.array(x, np.uint64).view(np.int64) for x in zip(*[hashes[k] for k in rng.permutation(len(hashes))]))
    assert linededup.Frequent(h1, h2).holds([*lines, b"", b" \t"]).tolist() == [x.strip().lower() in known for x in lines] + [False, False]
    assert not linededup.Frequent(h1[:0], h2[:0]).holds(lines).any()
