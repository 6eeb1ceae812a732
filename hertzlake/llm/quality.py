"""Quality classifier from weak labels.

Overlapping heuristic labellers call a document good or bad or abstain. Expectation-maximisation
estimates, without true labels, each labeller's accuracy in either class and the share of good
documents, from how often each pattern of votes occurs in the whole corpus. The posterior of its pattern is a
document's label, and a linear scorer over hashed features learns from the labels of a bounded sample.
The scorer judges every document, also where labellers abstain or contradict each other. Texts are read
for the votes, once more for the sample's features, and once more to be scored: no text is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, giving_back

GOOD, BAD, ABSTAIN = "1", "0", "-"
DIMS = 4096
#: Different texts with votes that the scorer is trained on, the first in the order of their hashes; with fewer, all.
SAMPLE = 8192
LEAST_SCORE = 0.5
#: Chance of the vote `good` for a bad and for a good document, before any is estimated.
START = (0.5, 0.995)
#: Words that a text's shares are shrunk by, as shares of few words tell little.
SHRINK = 8

#: Bytes by kind: capitals, letters (with all bytes of letters beyond ASCII), digits, blanks; marks stay.
_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256)
)
_MARKS = bytes(b for b in range(256) if _SHAPES[b] in b"aA0 ")


def _shaped(kinds: bytes) -> bytes:
    """Kinds of bytes with each run of letters, capitals or digits as one."""
    for one in (b"a", b"A", b"0"):
        two = one * 2
        while two in kinds:
            kinds = kinds.replace(two * 2, one).replace(two, one)
    return kinds


class Measured:
    """What labellers and features need to know of a text."""

    def __init__(self, text: str):
        data = text.encode()
        self.words = data.split()
        self.n = len(self.words)
        kinds = data.translate(_SHAPES)
        self.letters = kinds.count(b"a") + kinds.count(b"A")
        self.capitals = kinds.count(b"A")
        self.filled = len(data) - kinds.count(b" ")
        self.marks = len(data.translate(None, _MARKS))
        self.counts = Counter(self.words)
        self.shapes = Counter(_shaped(kinds).split())
        self.repeats = sum(map(eq, self.words, self.words[1:])) / max(1, self.n - 1)
        self.distinct = len(self.counts) / max(1, self.n)
        self.unlettered = sum(n for shape, n in self.shapes.items() if b"a" not in shape and b"A" not in shape) / max(1, self.n)


def _vote(value: float, good: float, bad: float) -> str:
    """Good up to `good`, bad from `bad` on, no vote between."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


LABELLERS: dict[str, Callable[[Measured], str]] = {
    "marks": lambda x: _vote(x.marks / max(1, x.filled), 0.06, 0.11) if x.filled >= 40 else ABSTAIN,
    "capitals": lambda x: _vote(x.capitals / max(1, x.letters), 0.15, 0.5) if x.letters >= 20 else ABSTAIN,
    "repeats": lambda x: _vote(x.repeats, 0.04, 0.25) if x.n >= 8 else ABSTAIN,
    "distinct": lambda x: _vote(1 - x.distinct, 0.6, 0.85) if x.n >= 40 else ABSTAIN,
    "unlettered": lambda x: _vote(x.unlettered, 0.04, 0.2) if x.n >= 8 else ABSTAIN,
    "shapes": lambda x: _vote(1 - sum(x.shapes[s] for s in (b"a", b"Aa", b"A", b"a.", b"a,")) / x.n, 0.15, 0.5) if x.n >= 8 else ABSTAIN,
}


NOBODY = ABSTAIN * len(LABELLERS)
#: Places that a step of the fit works on at once.
BLOCK = 1 << 20
#: Places (below DIMS), values, where each row starts, and each row's label between 0 and 1.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def hashed_features(x: Measured) -> tuple[np.ndarray, np.ndarray]:
    """Places of 2 and values of 4 bytes, hashed to DIMS places: shares of word shapes, of words, and of repeated and distinct words."""
    shares = {b"shape:" + shape: n / x.n for shape, n in x.shapes.items()}
    shares |= {b"=repeats": x.repeats, b"=same": 1 - x.distinct, b"=marks": x.marks / max(1, x.filled), b"=capitals": x.capitals / max(1, x.letters)}
    for word, n in x.counts.items():
        shares[word] = n / x.n
    found: dict[int, float] = {}
    for name, value in shares.items():
        at = zlib.crc32(name)
        found[at % DIMS] = found.get(at % DIMS, 0.0) + (value if at & 0x80000000 else -value) * x.n / (x.n + SHRINK)
    return np.fromiter(found, np.uint16, len(found)), np.fromiter(found.values(), np.float32, len(found))


def votes_of(x: Measured) -> str:
    """A letter for each labeller; a text without words gets no votes."""
    return "".join(labeller(x) for labeller in LABELLERS.values()) if x.n else NOBODY


def voted_documents(docs: DataFrame) -> DataFrame:
    """votes and place of each row of docs; place is the text's hash, by which texts are sampled."""

    def run(batches):
        for batch in batches:
            votes = [votes_of(Measured(text or "")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.string()), batch.column(0)], ["votes", "place"])

    return docs.select(_place(docs).alias("place"), "text").mapInArrow(giving_back(run), "votes string, place long")


def _place(docs: DataFrame) -> Column:
    return F.xxhash64(F.lit(3), docs["text"])


def fit_labellers(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good by pattern of votes; by labeller and class (bad, good) the chance of the vote `good`; the share of good.

    patterns: how often each pattern occurs. Labellers count as independent given the class; votes not cast
    tell nothing. Each labeller looks for one kind of junk, so they start as rarely wrong about good
    documents and as missing most bad ones.
    """
    names = sorted(patterns)
    width = len(names[0]) if names else 0
    weight = np.array([patterns[x] for x in names], float)
    cast = np.array([[v != ABSTAIN for v in x] for x in names], float).reshape(len(names), width)
    good = np.array([[v == GOOD for v in x] for x in names], float).reshape(len(names), width)
    says, share = np.tile([[START[0]], [START[1]]], (1, cast.shape[1])), 0.8
    for _ in range(rounds):
        chance = [np.log(p) + (good @ np.log(s) + (cast - good) @ np.log(1 - s)) for p, s in zip((1 - share, share), says)]
        posterior = 1 / (1 + np.exp(np.clip(chance[0] - chance[1], -500, 500)))
        for k, own in enumerate((1 - posterior, posterior)):
            says[k] = (own * weight @ good + START[k]) / (own * weight @ cast + 1)  # one vote of prior
        says = says.clip(1e-4, 1 - 1e-4)
        share = float(np.clip((posterior @ weight + 0.8) / (weight.sum() + 1), 1e-4, 1 - 1e-4))
    return dict(zip(names, posterior.tolist())), says, share


def blocks_of(features: pa.Table, posteriors: dict[str, float]) -> Iterator[Block]:
    """Rows of features (places, values, votes) in blocks of about BLOCK places, as views of the bytes that came."""
    for batch in features.to_batches():
        at, value = (_joined(batch.column(k), kind) for k, kind in ((0, np.uint16), (1, np.float32)))
        label = np.array([posteriors[x] for x in batch.column(2).to_pylist()])
        starts = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy() // value.itemsize))
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], BLOCK)), len(label)))
        for low, high in zip(cuts, cuts[1:]):
            yield at[starts[low] : starts[high]], value[starts[low] : starts[high]], starts[low:high] - starts[low], label[low:high]


def _joined(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """The numbers of all rows of a column of bytes, one after the other."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def fit_scorer(blocks: list[Block], rounds: int = 120, decay: float = 1e-5) -> np.ndarray:
    """Weights, the last one constant, of a logistic regression. No row is without places."""
    weights, total = np.zeros(DIMS + 1), sum(len(label) for *_, label in blocks)
    first, second = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for step in range(1, rounds + 1 if total else 1):
        slope = decay * weights
        for at, value, starts, label in blocks:
            score = np.add.reduceat(value * weights[at], starts) + weights[-1]
            wrong = (1 / (1 + np.exp(-score.clip(-500, 500))) - label) / total
            slope[:-1] += np.bincount(at, value * np.repeat(wrong, np.diff(starts, append=len(at))), DIMS)
            slope[-1] += wrong.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return weights


@dataclass(frozen=True)
class Model:
    posteriors: dict[str, float]
    weights: np.ndarray

    def score(self, x: Measured) -> float | None:
        if not x.n:
            return None
        places, values = hashed_features(x)
        return float(1 / (1 + np.exp(-np.clip(self.weights[places] @ values + self.weights[-1], -500, 500))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of docs: labellers from the counts of all rows' votes, the scorer from `sample` different texts.

    The driver gets the counts of at most 3^labellers vote patterns, a hash and the features of `sample`
    texts, each at most 6 * DIMS bytes, 200 MB for SAMPLE texts of whatever length. Where no labeller votes on any row, all weights are 0.
    """
    scratch = Scratch(docs.sparkSession)
    texts = scratch.stored(voted_documents(docs).groupBy("votes", "place").agg(F.count("*").alias("n")), "voted")
    found = texts.groupBy("votes").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).filter(F.col("votes") != NOBODY).collect()
    posteriors, _, _ = fit_labellers({x["votes"]: x["n"] for x in found})
    total = sum(x["texts"] for x in found)
    if not total:
        return Model(posteriors, np.zeros(DIMS + 1))
    some = texts.filter(F.col("votes") != NOBODY).select("place")
    # of many texts only about twice the sample is ordered, so that partitions don't send the driver a sample each
    most = min((1 << 63) - 1, (1 << 64) * 2 * sample // total - (1 << 63))
    last = lambda rows: rows.orderBy("place").limit(sample).agg(F.max("place"), F.count("*")).first()
    cut, n = last(some.filter(F.col("place") <= most))
    if n < min(sample, total):
        cut, n = last(some)
    scratch.clear()

    def run(batches):
        for batch in batches:
            measured = [Measured(text or "") for text in batch.column(1).to_pylist()]
            rows = []
            for place, x in zip(batch.column(0).to_pylist(), measured):
                votes = votes_of(x)
                if votes != NOBODY:
                    places, values = hashed_features(x)
                    rows.append((place, votes, places.tobytes(), values.tobytes()))
            columns = zip(*rows) if rows else [()] * 4
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["place", "votes", "places", "values"])

    chosen = docs.select(_place(docs).alias("place"), "text").filter(F.col("place") <= cut).groupBy("place").agg(F.first("text").alias("text"))
    featured = chosen.mapInArrow(giving_back(run), "place long, votes string, places binary, values binary")
    # numbers as bytes, so that the driver makes no object of each
    rows = featured.orderBy("place").limit(sample).select("places", "values", "votes").toArrow()
    return Model(posteriors, fit_scorer(list(blocks_of(rows, posteriors))))


def classify_quality(docs: DataFrame, least_score: float = LEAST_SCORE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, posterior, score, kept of each row of docs.

    posterior is null if no labeller votes. A null or empty text, or one without words, has no score and
    is not kept. Where no labeller votes on any row of docs, nothing tells good from bad: all scores are 0.5
    and rows with words are kept. Null and repeated ids are ids like others; repeated rows give repeated
    results, an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches):
        model = shared.value
        for batch in batches:
            measured = [Measured(text or "") for text in batch.column(1).to_pylist()]
            votes, scores = [votes_of(x) for x in measured], [model.score(x) for x in measured]
            kept = [x is not None and x >= least_score for x in scores]
            posteriors = [model.posteriors.get(x) for x in votes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(votes, pa.string()), pa.array(posteriors, pa.float64()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())],
                ["doc_id", "votes", "posterior", "score", "kept"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(giving_back(run), "doc_id long, votes string, posterior double, score double, kept boolean")


def good_documents(docs: DataFrame, least_score: float = LEAST_SCORE, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all columns, that classify_quality keeps; scored and filtered where they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(fit(docs, sample)), docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(Measured(text or "")) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x is not None and x >= least_score for x in scores], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)
