"""Best-fit packing after a Martello-Toth reduction.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. How pieces fill
sequences depends on their lengths alone, so the instance is a histogram: at most `capacity` numbers,
whatever the input. On it, small sets of lengths that dominate every alternative are fixed for good,
which shrinks the instance, and best-fit decreasing packs the rest. Both work on multiplicities. The
plan is a bounded table of intervals: the pieces of a length, numbered, fall into the intervals, and
an interval's formula gives sequence and offset.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, stored

CAPACITY = 4096
#: Pieces of one length that are numbered together are at most so many, or this share of all; more are split by salts.
NUMBERED, SHARES = 1000, 100_000
#: Entries of a worker's cache of blank-separated strings; longer ones aren't kept.
CACHE, CACHED_BYTES = 500_000, 64

#: A filled sequence: (length, copies) of its content, from the front.
Pattern = tuple[tuple[int, int], ...]


@dataclass
class Plan:
    """Patterns with their multiplicities; fixed counts the sequences the reduction settled."""

    patterns: list[tuple[Pattern, int]] = field(default_factory=list)
    fixed: int = 0

    def sequences(self) -> int:
        return sum(times for _, times in self.patterns)


def reduce_instance(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Fix dominating sets of at most two lengths; lowers counts and adds to plan, until nothing changes.

    From the longest length L, where s1 <= s2 <= s3 are the shortest pieces left besides it and M is the
    longest that fits with it:
    - L + s1 > capacity: nothing fits with L, it is alone.
    - L + M = capacity: what else shares L's sequence is no longer than M and can take M's place.
    - L + s1 + s2 > capacity: only one piece fits with L, and M is the longest such.
    - L + s1 + s2 + s3 > capacity and M >= the longest pair that fits with L: the pair can take M's place.
    """

    def shortest(without: int) -> list[int]:
        """The three shortest pieces left, not counting one piece of length `without`."""
        found: list[int] = []
        for x in np.flatnonzero(counts[1:] > 0) + 1:
            found += [int(x)] * min(3 - len(found), int(counts[x]) - (x == without))
            if len(found) == 3:
                break
        return found

    def longest_pair(room: int, without: int) -> int:
        left = counts.copy()
        left[without] -= 1
        have = np.flatnonzero(left[: room + 1] > 0)
        best, low, high = 0, 0, len(have) - 1
        while low <= high:
            total = int(have[low] + have[high])
            if total > room or low == high and left[have[low]] < 2:
                high -= 1
            else:
                best, low = max(best, total), low + 1
        return best

    def fix(pattern: Pattern, times: int) -> None:
        for length, copies in pattern:
            counts[length] -= copies * times
        plan.patterns.append((pattern, times))
        plan.fixed += times

    changed = True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while counts[length] > 0:
                room, few = capacity - length, shortest(length)
                if not few or few[0] > room:
                    fix(((length, 1),), int(counts[length]))
                    changed = True
                    break
                own = counts[: room + 1].copy()
                if length <= room:
                    own[length] -= 1
                mate = int(np.flatnonzero(own > 0)[-1])
                single = len(few) < 2 or few[0] + few[1] > room
                double = len(few) < 3 or sum(few) > room
                if not (mate == room or single or double and mate >= longest_pair(room, length)):
                    break
                # an equal decision follows until one of the two lengths runs out
                if mate == length:
                    fix(((length, 2),), int(counts[length]) // 2)
                elif mate == room or single:
                    fix(((length, 1), (mate, 1)), int(min(counts[length], counts[mate])))
                else:
                    fix(((length, 1), (mate, 1)), 1)
                changed = True


def best_fit(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Best-fit decreasing of what is left: each piece into the open sequence with the least room for it.

    Sequences with equal content are one group; a length fills groups from the tightest up, each with as
    many copies as go in, and opens new ones when none is left.
    """
    rooms: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    used = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            rooms[room].append((pattern, times))
            used[room] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            tight = np.argmax(used[length:]) + length
            if used[tight]:
                pattern, times = rooms[tight].pop()
                used[tight] = bool(rooms[tight])
                room = int(tight)
            else:
                pattern, times, room = (), -(-left // (capacity // length)), capacity
            copies = room // length
            full = min(times, left // copies)
            put(room - copies * length, (*pattern, (length, copies)), full)
            left -= full * copies
            times -= full
            if times and left:  # fewer than copies are left: one sequence takes them
                put(room - left * length, (*pattern, (length, left)), 1)
                times, left = times - 1, 0
            put(room, pattern, times if pattern else 0)
        counts[length] = 0
    for group in rooms:
        plan.patterns += group


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """counts[n]: the number of pieces of n tokens, n from 0 to capacity; counts[0] must be 0."""
    plan, left = Plan(), counts.astype(np.int64).copy()
    reduce_instance(left, capacity, plan)
    best_fit(left, capacity, plan)
    return plan


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: pieces above a - k are alone, what fills up to them is counted."""
    n = np.arange(len(counts))
    best = -(-int((n * counts).sum()) // capacity)
    for k in range(capacity // 2 + 1):
        big = int(counts[n > capacity - k].sum())
        middle = (n <= capacity - k) & (n > capacity // 2)
        small = (n <= capacity // 2) & (n >= k)
        free = int(counts[middle].sum()) * capacity - int((n * counts)[middle].sum())
        rest = max(0, int((n * counts)[small].sum()) - free)
        best = max(best, big + int(counts[middle].sum()) - (-rest // capacity))
    return best


def intervals(plan: Plan, capacity: int) -> pd.DataFrame:
    """Where the pieces go: those of a length, numbered from 0, from `start` on to sequence
    `first + (number - start) // copies`, at `at + (number - start) % copies * length`."""
    rows, taken, first = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, times in plan.patterns:
        at = 0
        for length, copies in pattern:
            rows.append((length, int(taken[length]), first, copies, at))
            taken[length] += copies * times
            at += copies * length
        first += times
    return pd.DataFrame(rows, columns=["length", "start", "first", "copies", "at"]).sort_values(["length", "start"])


#: Steps of the tokenizers that WordEncoder is written for. Fixed values.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False}


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases, drops blanks and splits words from marks.

    No token crosses a blank, so each blank-separated string is encoded once a cache life. In most of
    them Latin letters are followed by marks or nothing; the tokenizer splits there, normalisation
    leaves such letters as they are, and the word goes to the tokenizer's model directly.
    """

    MARKS = b".,!?;:*#$%&"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        #: Whether the tokenizer does what this class builds on; if not, it encodes whole texts.
        self.known = self._known()
        self.model = self.tokenizer.model
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: The model's sign of each byte; bytes that no UTF-8 text has are left out.
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {}
        for at in (*range(0x80), *range(0x80, 0x800, 64), *range(0x80, 0xC0)):
            sign = byte_level.pre_tokenize_str(chr(at))[0][0]
            signs.update(zip(chr(at).encode(), sign))
        self.signs = signs
        self.cache: dict[bytes, bytes] = {}

    def _known(self) -> bool:
        """Whether the file has the settings that this class is written for."""
        spec = json.loads(self.tokenizer.to_str())
        return all(spec[part] == settings for part, settings in SETTINGS.items()) and all(spec["model"][k] == v for k, v in MODEL.items())

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(self.MARKS)
        if word and word != chunk:
            ids = self.cache.get(word)
            if ids is None:
                ids = self._new(word)
                if len(word) <= CACHED_BYTES:
                    self.cache[word] = ids
            letters = word.decode().lower()
            if letters[-1].isalpha() and letters[-1] < "\u0250":
                marks = chunk[len(word) :]
                if len(marks) > CACHED_BYTES:
                    return ids + self.whole(marks)
                if marks not in self.cache:
                    self.cache[marks] = self.whole(marks)
                return ids + self.cache[marks]
            return self.whole(chunk)
        letters = chunk.decode().lower()
        if not letters.isalpha() or max(letters) >= "\u0250":
            return self.whole(chunk)
        found = self.model.tokenize(letters.encode().decode("latin-1").translate(self.signs))
        return np.array([x.id for x in found], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids, four bytes each, lowest first."""
        if not self.known:
            return self.whole(text.encode())
        data = text.encode().lower()
        if any(x in data for x in self.special):
            return self.whole(text.encode())
        if b"\xcc" in data or b"\xcd" in data:  # combining marks, which may depend on the letter's case
            data = text.encode()
        chunks = data.split()
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        own = {}  # long strings live as long as their text
        for chunk in set(chunks).difference(cache):
            (cache if len(chunk) <= CACHED_BYTES else own)[chunk] = self._new(chunk)
        return b"".join(map(cache.__getitem__, chunks) if not own else (own[x] if x in own else cache[x] for x in chunks))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder a worker and tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row of docs: its tokens and end_id, cut at capacity.

    A null text counts as empty and has the token end_id alone. No shuffle.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces with sequence_id and offset, in as few sequences as the plan finds.

    The driver gets the histogram of lengths and salts, at most capacity + SHARES numbers whatever the input,
    and returns the plan's intervals, a few for each length. Repeated rows are pieces of their
    own; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().toPandas().itertuples(index=False):
        counts[length] = n
    plan = plan_packing(counts, capacity)
    table = intervals(plan, capacity)
    base = np.cumsum(counts) - counts  # pieces before those of a length, if they stood in order
    # a length's pieces are numbered by salt; a cell is a length and a salt
    salts = np.maximum(1, -(-counts // max(NUMBERED, counts.sum() // SHARES)))
    first_cell = np.cumsum(salts) - salts
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(F.lit(salts.tolist()), F.col("length").cast("int"))).cast("int")
    salted = pieces.withColumn("salt", dealt if salts.max() > 1 else F.lit(0))
    sizes = np.zeros(salts.sum(), np.int64)
    if salts.max() > 1:
        for length, salt, n in salted.groupBy("length", "salt").count().toPandas().itertuples(index=False):
            sizes[first_cell[length] + salt] = n
    else:
        sizes[:] = counts
    ahead = np.cumsum(sizes) - sizes  # cells are in the order of lengths, so this is base and the salts before
    shared = spark.sparkContext.broadcast(
        (first_cell, ahead, (base[table["length"]] + table["start"]).to_numpy(), table[["first", "copies", "at"]].to_numpy())
    )
    numbered = salted.withColumn(
        "k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    )

    def place(frames):
        first_cell, offsets, starts, formulas = shared.value
        for x in frames:
            place = offsets[first_cell[x["length"]] + x["salt"].to_numpy()] + x["k"].to_numpy()
            row = np.searchsorted(starts, place, "right") - 1
            first, copies, at = formulas[row].T if len(x) else np.zeros((3, 0), np.int64)
            ahead = place - starts[row]
            yield x.drop(columns=["salt", "k"]).assign(sequence_id=first + ahead // copies, offset=at + ahead % copies * x["length"])

    return numbered.mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
