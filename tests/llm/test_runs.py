"""Runs of words against all stretches and periods."""

import hashlib
import random
import zlib

import pytest

from hertzlake.llm import runs


def brute_runs(words, least):
    n, every = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - at >= q:
                every.append((at, end - at + q, q))
            at = end + 1
    smallest = [(s, m, q) for s, m, q in every if not any(t <= s and s + m <= t + k and p < q for t, k, p in every)]
    return sorted((x for x in smallest if x[1] >= least), key=lambda x: (x[0], x[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice((1, 2, 2, 3, 4))
        words = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(40))]
        assert runs.find_runs(words, 2) == brute_runs(words, 2)
        assert runs.find_runs(words) == brute_runs(words, 12)


def test_runs_of_special_sequences():
    fibonacci = [b"a", b"ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    morse = "".join(str(bin(k).count("1") % 2) for k in range(256)).encode()
    for text in (fibonacci[-1], morse, b"a" * 200, b"abcab" * 40, b"abcde" * 3 + b"abcdx", (b"ab" * 9 + b"c") * 8, b"abcdefghijkl", b""):
        words = [bytes([x]) for x in text]
        assert runs.find_runs(words, 2) == brute_runs(words, 2)


def test_words_are_read_a_few_times():
    """Matches at a distance are read once, however often the words repeat."""

    class Counted(int):
        reads = 0

        def __eq__(self, other):
            Counted.reads += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    for period in (1, 2, 7, 500):
        Counted.reads = 0
        list(runs._roots([Counted(k % period) for k in range(20000)]))
        assert Counted.reads < 5 * 20000


def test_collapsed_words():
    words = [b"x", *[b"a", b"b"] * 6, b"y"]
    assert runs.find_runs(words) == [(1, 12, 2)]
    assert runs.collapsed(words, runs.find_runs(words)) == [b"x", b"a", b"b", b"y"]
    assert runs.collapsed(words, []) == words


def brute_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        first = list(words)
        for i in range(a, n):
            words[i] = first[a + (i - a) % p]
    found = brute_runs(words, 12)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    best = sorted(found, key=lambda x: (-x[1], x[0], x[2]))[:1]
    start, length, period = best[0] if best else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), start, length, period, length and 1000 * length // period,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)),
    )


@pytest.mark.parametrize("name", ["run_digests", "periodic_runs"])
def test_odd_rows(spark, name):
    long = " ".join(f"w{k % 37}é{k % 5}" for k in range(900))
    texts = [None, "", " \t\n", "one", "a b " * 30, "x y z " * 12, long, long, "A a " * 20 + "\x1c \x85 " * 8]
    rows = [(k, t, k % 3 == 0, "x") for k, t in enumerate(texts)] + [(30, "same words " * 9, None, None)] * 3 + [(None, "p q r " * 8, True, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start boolean, runs string").repartition(3)
    found = getattr(runs, name)(docs)
    if name == "run_digests":
        key = lambda x: (x[0] is None, *map(str, x))
        assert sorted((tuple(r)[:8] for r in found.collect()), key=key) == sorted((brute_row(i, t) for i, t, *_ in rows), key=key)
    else:
        by = {r.doc_id: r for r in found.collect()}
        assert found.count() == len(rows) and by[0].n_words == by[1].n_words == by[2].n_words == 0 and by[0].text == ""
        assert [tuple(x) for x in by[4].runs] == [(0, 60, 2)] and by[4].text == "a b"
        assert [tuple(x) for x in by[None].runs] == [(0, 24, 3)] and by[None].text == "p q r"
    assert getattr(runs, name)(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, folder, tmp_path):
    from hertzlake.llm.queries import queries

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("n_chars < 3000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: tuple(r)[:8] for r in queries()["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert found == {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect()}
    assert any(x[1] for x in found.values())
