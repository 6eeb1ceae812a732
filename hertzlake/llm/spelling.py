"""Groups of spelling variants: words one edit apart, and for each the frequent word that it is a variant of.

Pairs come from a positional q-gram inverted index with a count filter. A word of length n, filled up with q - 1 blanks
at both ends, has n + q - 1 grams with their places. One replaced letter leaves all but q of them at their
places; one inserted letter leaves all but q of the longer word's, at their places or one later. So words that are near
share LONGER - 1 grams, LONGER being the longer one's length, and of those one is among the first q + 1 grams of each, in any
one order of all grams (the first q of a shorter word). Words meet in a group for such a gram, with its place and the longer
length: the order is by rarity, so groups are small. A group is an index: its words' postings by gram and place. A word that
asks merges the postings of its grams in a heap, skips what can't reach the count, and what does is compared letter by letter.
A group of very many words is cut into parts, and whoever asks it asks each part, so that a task holds a part at most.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, if_small

Q = 3
#: Letters that grams tell apart: a to z, U+00C0 to U+00FF; others fall on these, which costs time but no pair.
LETTERS = 91
GRAMS = LETTERS**Q
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: How much more frequent a word's form is at least.
FACTOR = 2
#: Words that a task counts before it hands counts on.
HELD = 200_000
#: Words of a part of a group.
BLOCK = 4096

_WORD = re.compile("[A-Za-zÀ-ÿ]+")


class _Letters(dict):
    def __missing__(self, c: str) -> int:
        code = self[c] = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 64
        return code


_LETTERS = _Letters()


def grams_of(word: str) -> list[int]:
    """The grams of the filled up word, in order, as numbers under GRAMS."""
    filled = [0, 0, *map(_LETTERS.__getitem__, word), 0, 0]
    return [(a * LETTERS + b) * LETTERS + c for a, b, c in zip(filled, filled[1:], filled[2:])]


def one_edit_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def in_lists(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers found in at least so many of the ascending lists: a heap merge that skips what can't reach it."""
    heap = [(own[0], k) for k, own in enumerate(lists)]
    heapify(heap)
    at = [0] * len(lists)
    while len(heap) >= least:
        low, taken = heap[0][0], []
        while heap and heap[0][0] == low:
            taken.append(heappop(heap)[1])
        if len(taken) >= least:
            yield low
            low += 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heappop(heap)[1])
            if not heap:
                return
            low = heap[0][0]
        for k in taken:
            own = lists[k]
            at[k] = here = bisect_left(own, low, at[k])
            if here < len(own):
                heappush(heap, (own[here], k))


class Group:
    """The index of a group, whose words all have one length, and the gram that it stands for."""

    def __init__(self, rank: int, length: int, place: int, order: Callable[[int], int]):
        self.gram, self.length, self.order = (rank, place), length, order
        self.words: list[tuple[str, int]] = []
        self.grams: list[list[int]] = []
        self.postings: dict[int, list[int]] = {}
        self.first: dict[int, list[tuple[int, int]]] = {}

    def add(self, word: str, n: int, grams: list[int]) -> None:
        for place, gram in enumerate(grams):
            self.postings.setdefault(place * GRAMS + gram, []).append(len(self.words))
        self.words.append((word, n))
        self.grams.append(grams)

    def near(self, word: str, grams: list[int]) -> Iterator[tuple[str, int]]:
        """The index's words near a word of the same length or one letter shorter, each in one of the groups where the two meet."""
        shift = self.length - len(word)
        found = [own for place, gram in enumerate(grams) for k in range(shift + 1) if (own := self.postings.get((place + k) * GRAMS + gram))]
        least = self.length - 1
        if len(found) < least:
            return
        mine: list[tuple[int, int]] = []
        for at in in_lists(found, least):
            if one_edit_apart(self.words[at][0], word):
                mine = mine or first_grams(grams, self.order)[: Q + 1 - shift]
                if at not in self.first:
                    self.first[at] = first_grams(self.grams[at], self.order)
                if next(x for x in self.first[at] if any((x[0], x[1] - k) in mine for k in range(shift + 1))) == self.gram:
                    yield self.words[at]


def first_grams(grams: list[int], order: Callable[[int], int]) -> list[tuple[int, int]]:
    """rank, place of a word's first grams."""
    return sorted(zip(map(order, grams), range(len(grams))))[: Q + 1]


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, damage: int | None = None) -> DataFrame:
    """word, n: runs `[A-Za-zÀ-ÿ]+` of the texts with A-Z in lower case, and how often each occurs; those of so many code points.

    damage: a run loses the code point h % length where that number divides h, the crc32 of `doc_id:run`; a null doc_id damages none.
    Counts are summed by task before they are shuffled. Null and empty texts have no words; repeated rows count each.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                before = zlib.crc32(f"{doc_id}:".encode())
                # bytes lower A-Z alone
                for word, n in Counter(_WORD.findall((text or b"").lower().decode())).items():
                    if len(word) >= least_letters:
                        if damage and doc_id is not None and not (h := zlib.crc32(word.encode(), before)) % damage:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_letters:
                                continue
                        found[word] += n
            if len(found) > HELD:
                yield _counts(found)
                found = Counter()
        yield _counts(found)

    return docs.select("doc_id", "text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])


def _order(words: DataFrame) -> np.ndarray:
    """The rank of each gram by rarity; GRAMS numbers, whatever the number of words."""

    def counted(batches):
        for batch in batches:
            found = Counter(chain.from_iterable(map(grams_of, batch.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["gram", "n"])

    rows = words.select("word").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(GRAMS, np.int64)
    often[rows["gram"].to_numpy(np.int64)] = rows["n"]
    ranks = np.empty(GRAMS, np.int32)
    ranks[np.argsort(often, kind="stable")] = np.arange(GRAMS, dtype=np.int32)
    return ranks


def _asked(words: DataFrame, ranks) -> DataFrame:
    """rank, length, place, asks, word, n: the groups that a word is in, and those of longer words that it only asks."""

    def dealt(batches):
        order = memoryview(ranks.value).__getitem__
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, first = len(word), first_grams(grams_of(word), order)
                rows += [(rank, size, place, False, word, n) for rank, place in first]
                rows += [(rank, size + 1, place, True, word, n) for rank, place in {(r, p + k) for r, p in first[:Q] for k in (0, 1)}]
            names = ["rank", "length", "place", "asks", "word", "n"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)

    return words.select("word", "n").mapInArrow(dealt, "rank int, length int, place int, asks boolean, word string, n long")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, near, near_n: each ordered pair of different words (word, n; a stored table, a row a word) that are one edit apart, once."""
    spark, key = words.sparkSession, ["rank", "length", "place"]
    ranks = spark.sparkContext.broadcast(_order(words))
    asked = scratch.stored(_asked(words, ranks), "asked")
    large = asked.filter("not asks").groupBy(*key).count().filter(F.col("count") > BLOCK)
    large = scratch.stored(large.select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "large")
    parted = asked.join(if_small(large), key, "left").withColumn("own", F.when(~F.col("asks"), F.pmod(F.xxhash64("word"), "parts").cast("int")))
    # a word of a cut group is in one part and asks those before it
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.sequence(F.lit(0), F.col("own")))
    parted = parted.withColumn("part", F.explode(parts)).withColumn("asks", F.col("asks") | (F.col("part") < F.col("own")))
    parted = parted.select(*key, "part", "asks", "word", "n")
    met = parted.repartition(*key, "part").sortWithinPartitions(*key, "part", "asks", "word")

    def matched(batches):
        order = memoryview(ranks.value).__getitem__
        at, group = None, None
        for batch in batches:
            found = []
            for *here, asks, word, n in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if here != at:
                    at, group = here, Group(here[0], here[1], here[2], order)
                if asks and not group.words:
                    continue
                grams = grams_of(word)
                for near, near_n in group.near(word, grams):
                    found += [(word, near, near_n), (near, word, n)]
                if not asks:
                    group.add(word, n, grams)
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    return met.mapInArrow(matched, "word string, near string, near_n long")


def variant_groups(words: DataFrame, factor: int = FACTOR, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of a table (word, n) that have least_letters code points, 2 at least.

    n_near counts the words that are one edit apart. The form is the most frequent of them, of equal ones the first in code point
    order, if it is factor times as frequent as the word, else null, with form_n its count; the root is where forms lead from the word, itself if it has none.
    Rows of one word are summed, null words are ignored, an empty table gives an empty result, other columns are ignored.
    """
    if least_letters < 2 or factor < 2:
        raise ValueError("words of one letter share no gram, and forms must be more frequent")
    scratch = Scratch(words.sparkSession)
    known = words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n"))
    known = scratch.stored(known, "words")
    pairs = near_words(known, scratch).select("word", F.lit(None).cast("long").alias("n"), F.struct((-F.col("near_n")).alias("less"), "near").alias("best"))
    every = known.select("word", "n", F.lit(None).cast("struct<less:bigint,near:string>").alias("best")).union(pairs)
    best = every.groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * factor
    forms = best.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    forms = scratch.stored(forms, "forms")
    # a form is factor times as frequent as its word, so that paths end, and each round doubles what is behind a word
    roots = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    on = True
    while on:
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = roots.join(ahead, F.col("root") == F.col("at"), "left")
        moved = scratch.stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        on = not moved.filter("on").isEmpty()
        roots = moved.drop("on")
    named = forms.join(roots, "word", "left")
    result = scratch.stored(named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.clear(result)
    return result


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, damage: int | None = None) -> DataFrame:
    """variant_groups of the words of documents (doc_id, text) that occur least_count times; cases as in count_words."""
    return variant_groups(count_words(docs, damage=damage).filter(F.col("n") >= least_count))
