import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from hertzlake.llm import quality


def test_em_finds_the_labellers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.85
    says = [(0.3, 0.97), (0.5, 0.99), (0.4, 0.95), (0.2, 0.98)]
    patterns = {}
    for good in truth:
        votes = "".join("-" if rng.random() < 0.2 else "01"[int(rng.random() < pair[int(good)])] for pair in says)
        patterns[votes] = patterns.get(votes, 0) + 1
    posterior, found, share = quality.fit_labellers(patterns)
    assert abs(share - 0.85) < 0.02 and np.abs(found - np.array(says).T).max() < 0.06
    assert posterior["1111"] > 0.99 and posterior["0000"] < 0.01


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    found = quality.classify_quality(docs).join(labels, "doc_id").toPandas()  # the labels had no part in training
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert good.kept.mean() > 0.995 and (~bad.kept).mean() > 0.8


def plain_votes(text):
    """The six labellers anew, by patterns on bytes."""
    data = text.encode()
    words = data.split()
    if not words:
        return "------"
    n, filled = len(words), len(b"".join(words))
    capitals, letters = len(re.findall(rb"[A-Z]", data)), len(re.findall(rb"[A-Za-z\x80-\xff]", data))
    marks = filled - letters - len(re.findall(rb"[0-9]", data))
    twice = sum(words[k] == words[k - 1] for k in range(1, n)) / max(1, n - 1)
    shapes = plain_shapes(words)
    usual = sum(x in (b"a", b"Aa", b"A", b"a.", b"a,") for x in shapes)
    judged = [
        (filled >= 40, marks / max(1, filled), 0.06, 0.11), (letters >= 20, capitals / max(1, letters), 0.15, 0.5), (n >= 8, twice, 0.04, 0.25),
        (n >= 40, 1 - len(set(words)) / n, 0.6, 0.85), (n >= 8, sum(not re.search(rb"[aA]", x) for x in shapes) / n, 0.04, 0.2), (n >= 8, 1 - usual / n, 0.15, 0.5),
    ]
    return "".join("-" if not enough else "1" if x <= good else "0" if x >= bad else "-" for enough, x, good, bad in judged)


def plain_shapes(words):
    return [re.sub(rb"[0-9]+", b"0", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", x))) for x in words]


def plain_features(text):
    """A dense row: signed shares of shapes and words, and four of the whole text, by their crc32."""
    data = text.encode()
    words, row = data.split(), np.zeros(4096)
    n, filled = len(words), sum(map(len, data.split()))
    capitals, letters = len(re.findall(rb"[A-Z]", data)), len(re.findall(rb"[A-Za-z\x80-\xff]", data))
    marks = filled - letters - len(re.findall(rb"[0-9]", data))
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)
    whole = {b"=repeats": same, b"=same": 1 - len(set(words)) / n, b"=marks": marks / max(1, filled), b"=capitals": capitals / max(1, letters)}
    parts = [(b"shape:" + x, 1 / n) for x in plain_shapes(words)] + [(x, 1 / n) for x in words if x not in whole] + list(whole.items())
    for name, share in parts:
        h = zlib.crc32(name)
        row[h % 4096] += (share if h >> 31 else -share) * n / (n + 8)
    return row


def plain_posteriors(votes):
    """Expectation-maximisation document by document, in plain loops."""
    cast = [x for x in votes if x != "------"]
    says, share = {0: [0.5] * 6, 1: [0.995] * 6}, 0.8
    counts = Counter(cast)
    for _ in range(200):
        found = {}
        for x in counts:
            odds = math.log(1 - share) - math.log(share)
            for k, v in enumerate(x):
                if v != "-":
                    odds += math.log(says[0][k] if v == "1" else 1 - says[0][k]) - math.log(says[1][k] if v == "1" else 1 - says[1][k])
            found[x] = 1 / (1 + math.exp(odds))
        for c, start in ((0, 0.5), (1, 0.995)):
            own = {x: (found[x] if c else 1 - found[x]) * n for x, n in counts.items()}
            for k in range(6):
                yes, all_ = (sum(w for x, w in own.items() if x[k] in allowed) for allowed in ("1", "01"))
                says[c][k] = min(1 - 1e-4, max(1e-4, (yes + start) / (all_ + 1)))
        share = min(1 - 1e-4, max(1e-4, (sum(found[x] * n for x, n in counts.items()) + 0.8) / (len(cast) + 1)))
    return found


def plain_weights(x, label):
    """Logistic regression with Adam, 120 steps at 0.3, on a dense table with a last column of ones."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = np.zeros(4097), np.zeros(4097), np.zeros(4097)
    for step in range(1, 121):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - label) / len(x) + 1e-5 * w
        m, v = m * 0.9 + g * 0.1, v * 0.999 + g * g * 0.001
        w = w - 0.3 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def brute(rows):
    """The operator's definition row by row, with none of its functions: votes, posteriors, the sample by hash order, scores."""
    import xxhash

    def place(text):
        seed = xxhash.xxh64_intdigest((3).to_bytes(4, "little"), 42)
        found = seed if text is None else xxhash.xxh64_intdigest(text.encode(), seed)
        return found - (1 << 64) if found >> 63 else found

    texts = [text or "" for _, text in rows]
    votes = [plain_votes(x) for x in texts]
    posteriors = plain_posteriors(votes)
    places = {place(rows[k][1]): k for k in range(len(rows)) if votes[k] != "------"}
    picked = [places[x] for x in sorted(places)[:60]]
    weights = plain_weights(np.array([plain_features(texts[k]) for k in picked]), np.array([posteriors[votes[k]] for k in picked]))
    for (doc_id, _), text, v in zip(rows, texts, votes):
        score = 1 / (1 + math.exp(-(plain_features(text) @ weights[:-1] + weights[-1]))) if text.split() else None
        yield str(doc_id), v, posteriors.get(v), score, score is not None and score >= 0.5


def test_equals_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + [(None, "Null ids too, " * 9), (7000, None), (7001, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((str(r.doc_id), r.votes, r.posterior, r.score, r.kept) for r in quality.classify_quality(docs, sample=60).collect())
    expected = sorted(brute(rows))
    assert [x[:2] + x[4:] for x in found] == [x[:2] + x[4:] for x in expected]
    assert all(a[k] is b[k] is None or abs(a[k] - b[k]) < limit for a, b in zip(found, expected) for k, limit in ((2, 1e-9), (3, 1e-3)))
    kept = [(r.doc_id, r.text) for r in quality.good_documents(docs, sample=60).collect()]
    assert sorted(map(str, kept)) == sorted(str(row) for row, x in zip(rows, brute(rows)) if x[4])


def test_rows_without_ids_are_judged(spark):
    clean = "The house of wonders stands by the river, and the people of the town pass it on their way. "
    rows = [(None, clean * (1 + k % 7)) for k in range(1600)] + [(None, "BUY!! NOW!! $$$ ### ***&&& " * (15 + k % 3)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.classify_quality(docs, sample=50).collect()
    assert sum(r.kept for r in found) == 1600 and quality.good_documents(docs, sample=50).filter("text LIKE 'BUY%'").count() == 0


def test_without_any_vote_all_words_stay(spark):
    docs = spark.createDataFrame([(1, "Yes."), (2, "No no"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: (r.score, r.kept) for r in quality.classify_quality(docs).collect()} == {1: (0.5, True), 2: (0.5, True), 3: (None, False)}


def test_shapes():
    assert quality.Measured("Aaa BBB a1b22 éé. x--y").shapes == {b"Aa": 1, b"A": 1, b"a0a0": 1, b"a.": 1, b"a--a": 1}


def test_cases(spark):
    clean = "The house of wonders stands by the river, and the people of the town pass it on their way. "
    rows = [(k, clean * (1 + k % 5), "x") for k in range(200)] + [(300 + k, "BUY!! NOW!! $$$ ### ***&&& " * 20, "x") for k in range(20)]
    rows += [(400, None, "x"), (401, "", "x"), (402, " \n", "x"), (403, clean * 2000, "x"), (404, "Yes.", "x"), (0, clean, "x"), (None, clean, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = quality.classify_quality(docs).collect()
    assert len(found) == len(rows)
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[k] for k in range(200)) and not any(kept[300 + k] for k in range(20))
    assert [kept[k] for k in (400, 401, 402, 403, 404, None)] == [False, False, False, True, True, True]
    assert quality.classify_quality(docs.limit(0)).count() == 0 and quality.classify_quality(docs.filter("doc_id = 400")).count() == 1


def test_blocks_are_views_of_all_rows(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 4096, n).astype(np.uint16), rng.random(n).astype(np.float32)) for n in rng.integers(1, 12, 50)]
    votes = ["1-"[k % 2] for k in range(50)]
    table = pa.table({"places": [a.tobytes() for a, _ in rows], "values": [v.tobytes() for _, v in rows], "votes": votes}).slice(3)
    blocks = list(quality.blocks_of(table, {"1": 0.9, "-": 0.1}))
    got = [x for at, value, starts, label in blocks for x in zip(np.split(at, starts[1:]), np.split(value, starts[1:]), label)]
    assert len(blocks) > 20 and len(got) == 47
    assert all((a == p).all() and (v == w).all() and y == (0.9 if x == "1" else 0.1) for (a, v, y), (p, w), x in zip(got, rows[3:], votes[3:]))
    dense = np.zeros((47, 4096))
    for k, (a, v, _) in enumerate(got):
        np.add.at(dense[k], a, v)
    assert np.abs(quality.fit_scorer(blocks) - plain_weights(dense, np.array([y for *_, y in got]))).max() < 1e-6
    assert not quality.fit_scorer([]).any()
