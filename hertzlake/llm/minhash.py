"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian verification, exact check.

Documents with equal shingle sets form a class with one signature. Classes that agree in a band of
their signatures are candidates. A candidate pair's signatures are compared batch by batch; as soon as
the posterior probability of a similarity at or over the threshold falls under the chosen miss
probability, the pair is dropped. What survives is decided on the full sets.

A large bucket isn't turned into pairs. First all its members meet one pivot, the member with the most
company over all bands. Mostly that joins a group of copies into one component. Then only pairs of
different components are open, and those are compared in blocks: the members outside the bucket's
largest component against all members.

What travels is small first. Candidates are pruned by sketches, a byte of each signature entry: entries
that agree have equal bytes, so a sketch prunes no pair that its signature wouldn't. Full sets are read
for the members of surviving pairs only, and a pivot's set goes once to each group of its members.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, giving_back, if_small
from .components import connected_components

WORDS = 5
#: Similarity threshold as a fraction of whole numbers, so that the check is exact.
NUMERATOR, DENOMINATOR = 75, 100
#: Pairs at the threshold share no band with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
BLOCK = 256
#: Members that are checked against one copy of their pivot's set.
GROUP = 64
#: Words whose hashes a worker keeps, and their bytes at most.
CACHE, CACHED_BYTES = 300_000, 64

_RANDOM = np.random.default_rng(20)
_MULTIPLY = _RANDOM.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_FLIP = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
_PLACE = _RANDOM.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_words: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of WORDS words, A-Z in lower case, whole text.

    Fewer words are one shingle; none give an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    if len(_words) > CACHE:
        _words.clear()
    own = {}  # long words live as long as their text
    for word in set(words).difference(_words):
        (_words if len(word) <= CACHED_BYTES else own)[word] = xxhash.xxh64_intdigest(word)
    known = _words | own if own else _words
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(WORDS):
        mixed = (mixed ^ hashes[k : k + n]) * _PLACE[k]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima over a non-empty set."""
    low = (found >> np.uint64(16)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        part = low[at : at + 512, None] ^ _FLIP
        part *= _MULTIPLY
        part ^= part >> np.uint32(15)
        part *= _MULTIPLY[::-1]
        np.minimum(least, part.min(0), out=least)
    return least


def least_agreements(miss: float = MISS) -> list[int]:
    """By batch: the fewest agreements so far at which the posterior is not under miss.

    With a uniform prior, P(similarity >= t | m of n agree) = P(Binomial(n + 1, t) <= m).
    """
    t, found = NUMERATOR / DENOMINATOR, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        found.append(m)
    return found


def survivors(left: np.ndarray, right: np.ndarray, miss: float = MISS) -> np.ndarray:
    """Places of the rows of two signature tables that no batch prunes."""
    alive, agree = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_agreements(miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (left[alive, part] == right[alive, part]).sum(1)
        stay = agree >= least
        alive, agree = alive[stay], agree[stay]
    return alive


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """The exact decision on two sorted sets."""
    small, large = sorted((len(one), len(other)))
    if DENOMINATOR * small < NUMERATOR * large:
        return False
    both = np.concatenate((one, other))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * shared >= NUMERATOR * (small + large - shared)


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the lower bits of a key tell its band."""
    rows = signed.reshape(-1, BANDS, ROWS)
    keys = np.zeros(rows.shape[:2], np.uint64)
    for k in range(ROWS):
        keys = (keys ^ rows[:, :, k]) * _PLACE[k]
        keys ^= keys >> np.uint64(29)
    return keys // np.uint64(BANDS) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)


def _features(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (the set's digest), signature (null for an empty set)."""

    def run(batches):
        for batch in batches:
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            digests = [np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets]
            signed = [signature(x).tobytes() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([x[0] for x in digests], pa.int64()),
                    pa.array([x[1] for x in digests], pa.int64()), pa.array(signed, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.stored(picked.mapInArrow(giving_back(run), "doc_id long, n_shingles long, set_a long, set_b long, signature binary"), "shingled")


def _signed(classes: DataFrame) -> DataFrame:
    """id, keys (array<long>, one for each band) and sketch of the classes."""

    def run(batches):
        for batch in batches:
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(signed).reshape(-1).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            sketches = pa.array([x.tobytes() for x in signed.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, sketches], ["id", "keys", "sketch"])

    return classes.select("id", "signature").mapInArrow(giving_back(run), "id long, keys array<long>, sketch binary")


def _members(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, n of the classes that share a bucket with n - 1 other classes."""
    banded = reps.select(F.explode("keys").alias("key"), "id")
    sizes = scratch.stored(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    return scratch.stored(banded.join(sizes, "key").select("key", "id", "n"), "members")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _pruned(pairs: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (id, pivot) that sketch batches don't prune, and in how many entries they agree."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                one, other = _sketches(part.column(2)), _sketches(part.column(3))
                stay = survivors(one, other)
                agree = (one[stay] == other[stay]).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(stay)) for k in (0, 1)), pa.array(agree)], ["id", "pivot", "agree"])

    signed = reps.select("id", "sketch")
    met = pairs.join(signed, "id").join(signed.select(F.col("id").alias("pivot"), F.col("sketch").alias("other")), "pivot")
    return scratch.stored(met.select("id", "pivot", "sketch", "other").mapInArrow(giving_back(run), "id long, pivot long, agree int"), "survivors")


def _sets(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """id and the full set of the given documents, ids being a written table of distinct ids."""

    def run(batches):
        for batch in batches:
            found = [shingles(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(if_small(ids), "id", "left_semi")
    return scratch.stored(picked.mapInArrow(giving_back(run), "id long, shingles binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (id, pivot) whose full sets meet the threshold, as links a, b.

    A pivot's members are dealt into groups of about GROUP; its set goes to each group once, before theirs.
    """
    ids = scratch.stored(pairs.select("id").union(pairs.select("pivot")).distinct(), "needed")
    sets = _sets(docs, ids, scratch)
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(groups, "pivot").select("id", "pivot", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part"))
    members = dealt.join(sets, "id").select("pivot", "part", F.lit(1).alias("rank"), "id", "shingles")
    heads = groups.select("pivot", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")).join(sets, F.col("pivot") == F.col("id"))
    heads = heads.select("pivot", "part", F.lit(0).alias("rank"), "id", "shingles")

    def run(batches):
        heads, own = [], None  # more than one where texts share the pivot's id
        for batch in batches:
            found = []
            for pivot, part, rank, member, shingled in zip(*(x.to_pylist() for x in batch.columns)):
                one = np.frombuffer(shingled, np.uint64)
                if rank == 0:
                    heads, own = [*(heads if own == (pivot, part) else ()), one], (pivot, part)
                elif own == (pivot, part) and any(linked(head, one) for head in heads):
                    found.append((min(member, pivot), max(member, pivot)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    order = ["pivot", "part", "rank"]
    together = heads.union(members).repartition("pivot", "part").sortWithinPartitions(*order)
    return scratch.stored(together.mapInArrow(giving_back(run), "a long, b long"), "links")


def _pivots(members: DataFrame, scratch: Scratch) -> DataFrame:
    """key, pivot: the member whose buckets hold the most members in all."""
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    most = F.max(F.struct("company", "id")).alias("m")
    return scratch.stored(members.join(company, "id").groupBy("key").agg(most).select("key", F.col("m.id").alias("pivot")), "pivots")


def _blocks(rest: DataFrame, open_: DataFrame, columns: list[str]) -> DataFrame:
    """key, block, chunk, outside and columns: the open buckets' members, dealt so that each one outside the largest component meets all."""
    every = rest.join(open_, "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    all_members = every.select("key", *columns, F.lit(False).alias("outside"), deal("blocks", 1).alias("block"), spread("chunks").alias("chunk"))
    outside = every.filter("root != main").select("key", *columns, F.lit(True).alias("outside"), spread("blocks").alias("block"), deal("chunks", 2).alias("chunk"))
    return all_members.union(outside)


def _met(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of different components in a block that sketch batches don't prune, and their agreements, most first.

    A pair is met in the first band in which it agrees, which a key's lower bits tell.
    """
    signed = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, HASHES)
    roots, out = rows["root"].to_numpy(), rows["outside"].to_numpy()
    x, y = np.flatnonzero(out), np.flatnonzero(~out)
    i, j = np.nonzero(roots[x][:, None] != roots[y][None, :])
    i, j = x[i], y[j]
    stay = survivors(signed[i], signed[j])
    i, j = i[stay], j[stay]
    keys = np.stack(rows["keys"].to_numpy())
    first = (keys[i] == keys[j]).argmax(1) == int(rows["key"].iloc[0]) % BANDS
    i, j = i[first], j[first]
    agree = (signed[i] == signed[j]).sum(1)
    best = np.argsort(-agree, kind="stable")
    return i[best], j[best], agree[best]


def _open_links(members: DataFrame, pivots: DataFrame, reps: DataFrame, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components so far of a bucket's members, besides its pivot.

    Members outside the bucket's largest component are compared with all, BLOCK against BLOCK, by sketches;
    then those that a pair survives for are compared again with full sets, the most similar first; one
    link joins two components, so their other pairs need none.
    """
    rest = members.filter("n > 2").join(pivots, "key").filter("id != pivot")
    rest = scratch.stored(rest.join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "rest")
    parts = rest.groupBy("key", "root").agg(F.count("*").alias("size"))
    open_ = parts.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("parts"), F.max(F.struct("size", "root")).alias("largest"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = scratch.stored(
        open_.filter("parts > 1").select(
            "key", F.col("largest.root").alias("main"), blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("largest.size")).alias("chunks")
        ),
        "open",
    )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = _met(rows)
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"key": rows["key"].iloc[0], "id": np.unique(np.concatenate((ids[i], ids[j])))})

    signed = rest.join(reps.select("id", "keys", "sketch"), "id")
    columns = ["id", "root", "keys", "sketch"]
    needed = scratch.stored(_blocks(signed, open_, columns).groupBy("key", "block", "chunk").applyInPandas(meet, "key long, id long").distinct(), "met")
    ids = scratch.stored(needed.select("id").distinct(), "needed")
    sets = _sets(docs, ids, scratch)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        names, roots = np.unique(rows["root"].to_numpy(), return_inverse=True)
        ids, whole = rows["id"].to_numpy(), [np.frombuffer(z, np.uint64) for z in rows["shingles"]]
        group, found = np.arange(len(names)), []
        for a, b in zip(*_met(rows)[:2]):
            one, other = group[roots[a]], group[roots[b]]
            if one != other and linked(whole[a], whole[b]):
                group[group == other] = one
                found.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    full = signed.join(needed, ["key", "id"]).join(sets, "id")
    found = _blocks(full, open_, [*columns, "shingles"]).groupBy("key", "block", "chunk").applyInPandas(compare, "a long, b long")
    return scratch.stored(found.distinct(), "open-links")


def _same_id(full: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between an id that rows with different sets share and the classes of these."""
    sets = F.struct("set_a", "set_b")
    shared = full.groupBy("doc_id").agg(F.min(sets).alias("one"), F.max(sets).alias("other")).filter("one != other").select("doc_id")
    rows = full.join(if_small(scratch.stored(shared, "shared-ids")), "doc_id", "left_semi").select("doc_id", "set_a", "set_b").distinct()
    met = classes.select("set_a", "set_b", "id").join(if_small(scratch.stored(rows, "shared-sets")), ["set_a", "set_b"])
    return met.select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b")).filter("a != b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of each row of docs.

    Two documents are linked if 100 * intersection >= 75 * union of their shingle sets. A null or empty
    text, or one without words, has an empty set and is linked with nothing. Rows with one doc_id are one
    document, linked with what any of them is; a row with a null doc_id has a null component and is kept.
    An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    features = _features(docs, scratch)
    full = features.filter("signature is not null and doc_id is not null")
    first = F.min(F.struct("doc_id", "signature")).alias("m")
    classes = full.groupBy("set_a", "set_b").agg(first, F.count("*").alias("n"))
    classes = scratch.stored(classes.select("set_a", "set_b", "n", F.col("m.doc_id").alias("id"), "m.signature"), "classes")
    reps = scratch.stored(_signed(classes), "signed")
    members = _members(reps, scratch)
    pivots = _pivots(members, scratch)
    stars = members.join(pivots, "key").filter("id != pivot")
    pairs = scratch.stored(stars.select("id", "pivot").distinct(), "pairs")
    links = _verified(_pruned(pairs, reps, scratch), docs, scratch).union(_same_id(full, classes, scratch))
    labels = connected_components(links, scratch)
    more = _open_links(members, pivots, reps, docs, labels, scratch)
    labels = connected_components(links.union(more), scratch)
    least = labels.groupBy("root").agg(F.min("id").alias("component_id"))
    groups = labels.join(least, "root").select("id", "component_id")
    named = classes.join(groups, "id", "left").select("set_a", "set_b", "n", F.coalesce("component_id", "id").alias("component_id"), "id")
    named = scratch.stored(named.filter("n > 1 or component_id != id").select("set_a", "set_b", "component_id"), "named")
    # empty sets have one digest and no name, so they stay out of the join
    some = F.when(F.col("n_shingles") > 0, F.col("set_a")).otherwise(F.xxhash64("doc_id"))
    keyed = features.select("doc_id", "n_shingles", some.alias("set_a"), F.when(F.col("n_shingles") > 0, F.col("set_b")).alias("set_b"))
    filled = keyed.join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    scratch.clear(features, named)
    return filled.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
