"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a byte string ends in one token only, and the encoding of a prefix is that of the
shorter prefix before this token, plus the token. So one number a prefix, its last token, holds the
encodings of all prefixes. Token t, which ends at k and starts at j, is the last token of prefix k
exactly if BPE leaves the two tokens (last token of prefix j, t) as they are when it encodes their
joined bytes. That makes appends exact without a look at the encoded bytes before the longest token,
and edits cheap: behind an edit the numbers soon repeat the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries of a worker's piece cache and of its table of token pairs; both are emptied when full. Longer pieces aren't kept.
CACHE = 500_000
PAIRS = 500_000
CACHED_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes byte strings with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Node of the tokens' tree: byte to node, and under -1 the token that ends here.
        self.tree: dict = {}
        for token, rank in ranks.items():
            node = self.tree
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = rank
        self._pairs: dict[tuple[int | None, int], bool] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain BPE, the definition; used on the bytes of two tokens at most."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], len(self.ranks) + 1), i) for i in range(len(parts) - 1)
            )
            if rank > len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: int | None, token: int) -> bool:
        """Whether BPE leaves (before, token) as they are; before is None at the start."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        own = [] if before is None else [self.tokens[before]]
        own.append(self.tokens[token])
        known = self._pairs[before, token] = self._merged(b"".join(own)) == own
        return known

    def _fill(self, data: bytes, last: list[int | None], done: int, start: int) -> Iterator[int]:
        """Fill last[k] for k > done from the tokens that start at start or later; yields each settled k."""
        pairs = self._pairs
        for j in range(start, len(data)):
            if j > done:
                yield j
            before, node, k = last[j], self.tree, j
            for byte in data[j : j + self.longest]:
                node = node.get(byte)
                if node is None:
                    break
                k += 1
                if k > done and last[k] is None:
                    token = node.get(-1)
                    if token is not None:
                        fits = pairs.get((before, token))
                        if self._fits(before, token) if fits is None else fits:
                            last[k] = token
        yield len(data)

    def prefix_tokens(self, data: bytes) -> list[int | None]:
        """last[k]: the last token of the encoding of data[:k]; last[0] is None."""
        last: list[int | None] = [None] * (len(data) + 1)
        for _ in self._fill(data, last, 0, 0):
            pass
        return last

    def append(self, data: bytes, last: list[int | None], more: bytes) -> tuple[bytes, list[int | None]]:
        """data + more and its last tokens; only the longest token's length before the seam is read."""
        whole, grown = data + more, last + [None] * len(more)
        for _ in self._fill(whole, grown, len(data), max(0, len(data) - self.longest + 1)):
            pass
        return whole, grown

    def edit(
        self, data: bytes, last: list[int | None], start: int, end: int, new: bytes
    ) -> tuple[bytes, list[int | None], int]:
        """data with data[start:end] replaced, its last tokens, and how many of them were computed.

        Work stops where the last tokens have repeated the old ones over the longest token's length:
        from there on both depend on equal bytes and equal numbers only.
        """
        whole = data[:start] + new + data[end:]
        shift = len(whole) - len(data)
        fresh: list[int | None] = last[: start + 1] + [None] * (len(whole) - start)
        same = 0
        for k in self._fill(whole, fresh, start, max(0, start - self.longest + 1)):
            old = k - shift
            same = same + 1 if old > end and last[old] == fresh[k] else 0
            if same >= self.longest:
                fresh[k:] = last[old:]
                return whole, fresh, k - start
        return whole, fresh, len(whole) - start

    def ids(self, data: bytes, last: list[int | None] | None = None) -> list[int]:
        last = self.prefix_tokens(data) if last is None else last
        at, found = len(data), []
        while at:
            found.append(last[at])
            at -= len(self.tokens[last[at]])
        return found[::-1]


class TextEncoder:
    """Encodes texts: each match of the pattern separately, equal matches once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = PrefixEncoder(ranks)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        pieces = self.pattern.findall(text)
        if len(self.cache) > CACHE:
            self.cache.clear()
        own = {}  # long pieces live as long as their text
        for piece in set(pieces).difference(self.cache):
            (self.cache if len(piece) <= CACHED_CHARS else own)[piece] = self.encoder.ids(piece.encode())
        ids: list[int] = []
        for found in map(self.cache.__getitem__, pieces) if not own else (own[x] if x in own else self.cache[x] for x in pieces):
            ids += found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoder.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def _encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder a worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary (the bytes decoded from ids) of each row of docs.

    The text is doc_id's whole text; null counts as empty. Repeated rows give repeated results, an
    empty text gives no ids, an empty table an empty result; columns other than doc_id and text are
    ignored. No shuffle; a worker holds one batch and its bounded caches.
    """

    def run(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            ids = [encoder.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([encoder.decode(x) for x in ids], pa.binary()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode_documents, reduced in the same task to n_tokens, ids_sha256 and decoded_sha256.

    The same rows and cases as encode_documents; the ids need not leave the worker.
    """

    def run(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "")
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256(encoder.decode(ids)).hexdigest(),
                    )
                )
            n, ids_sha, decoded_sha = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
