"""Periodic runs of words, by Lyndon arrays over an ordered alphabet.

A run is a stretch with a smallest period, at least two periods long, that no neighbour extends. With the words
ordered, and again in the reversed order, every run has a Lyndon word of its period's length as its root, and that is
the longest Lyndon word where it begins (Bannai et al.). So the edges from each place to its next smaller suffix,
in both orders, are candidates for all runs, fewer than two a word. Suffixes are compared from the right to
the left, and what a comparison has matched at a distance is kept with that distance: a later one at the same distance
goes on from there and doesn't read those words again (after Ellert and Fischer). Words are compared
with each other only; there is no suffix array, tree or hash of stretches.

A document is one string and so one task's work; documents are worked on where they are, without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a run has at least.
LEAST_LENGTH = 12

Run = tuple[int, int, int]


def _roots(a: list[int]) -> Iterator[Run]:
    """i, j, reach: edges from a place to its next smaller suffix whose words agree up to before a[j + reach]; reach is positive."""
    n = len(a)
    beyond = [n] * (n + 1)
    #: distance: (from, to) of the last match, which is the leftmost
    matched: dict[int, tuple[int, int]] = {}
    for i in range(n - 2, -1, -1):
        own, j = a[i], i + 1
        while j < n:
            other = a[j]
            if own < other:
                j = beyond[j]
                continue
            if own > other:
                break
            distance = j - i
            first, last = matched.get(distance, (n, n))
            at = i + 1
            while at < first and at + distance < n and a[at] == a[at + distance]:
                at += 1
            if at == first:
                at = last
            matched[distance] = i, at
            if at + distance < n and a[at] < a[at + distance]:
                j = beyond[j]
                continue
            yield i, j, at - i
            break
        beyond[i] = j


def find_runs(words: list[bytes], least: int = LEAST_LENGTH) -> list[Run]:
    """(start, length, period) of all runs of at least so many words, by start and period."""
    places = {word: k for k, word in enumerate(sorted(set(words)))}
    up = [places[word] for word in words]
    found = set()
    for a in (up, [-x for x in up]):
        for i, j, reach in _roots(a):
            period, back = j - i, 0
            # another root lies left of this one where a whole period matches there
            while back < period and back < i and a[i - back - 1] == a[j - back - 1]:
                back += 1
            if back < period <= back + reach and back + reach + period >= least:
                found.add((i - back, back + reach + period, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [word for word, depth in zip(words, accumulate(change)) if not depth]


def words_of(text: bytes | None) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+`: bytes are split at ASCII blanks alone."""
    return (text or b"").split()


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """words with a periodic end where crc32 of doc_id in decimal ends in 0; else, and without an id, as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % period] for k in range(n - a)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and text without the repeats, of each row.

    The text's kept words are joined by a space. A null or blank text has no words, no runs and an empty text; repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                own = find_runs(words, least)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), x)) for x in own])
                texts.append(b" ".join(collapsed(words, own)).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "text"])

    return picked.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string")


DIGESTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"


def _digests(words: list[bytes], least: int) -> tuple:
    runs = find_runs(words, least)
    start, length, period = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(collapsed(words, runs))
    milli = None if length is None else 1000 * length // period
    return len(runs), start, length, period, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words)


def run_digests(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and DIGESTS of each row of docs (doc_id, text), whose words have had their end repeated as repeated_tail does.

    start, length, period and exponent_milli are those of the longest run (of equal ones the first, then that of the smallest
    period), null without a run. Other cases as in periodic_runs.
    """
    picked = docs.select(F.col("doc_id"), F.col("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in DIGESTS.split(", "))]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [_digests(repeated_tail(i, words_of(text)), least) for i, text in zip(batch.column(0).to_pylist(), texts)]
            columns = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return picked.mapInArrow(run, f"doc_id {kind}, {DIGESTS}")
