"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text: at-signs, dots and plus signs before a digit,
digits, scheme separators and identifier cues in any case. A deterministic parser for each kind expands
an anchor over neighbouring characters and validates what it finds: an account number by its form or
check digits. Parsers of one kind work from left to right and start behind their own last match, so their
matches are leftmost and do not overlap; they look at a cheap condition first, so that text that repeats an
anchor costs no more than other text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import giving_back

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
DIALLED = DIGITS | frozenset(" ().-")
ENDS_URL = frozenset(" \t\n\x0b\x0c\r<>\"'`{}|\\^")
SECRET = LETTERS | DIGITS | frozenset("-_")
#: Words before an account number or a secret, in lower case. Fixed values.
CUES = (
    "account", "acct", "iban", "passport", "token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "ssn", "social security",
)
#: Words that may stand between a cue and its value. Fixed values.
LINKS = ("number", "no.", "no", "nr.", "nr", "id", "is", "key")
#: Letters and digits that such a value has at least; values without a digit are words.
LEAST_VALUE = 6
#: Letters and digits of an IBAN at most.
LONGEST_IBAN = 34

Span = tuple[int, int]


def email_at(text: str, at: int, free: int) -> tuple[Span | None, int]:
    """The address around the at-sign at `at` that starts at `free` or later; where the next one may start."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = at + 1
    n = len(text)
    while end < n and text[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return None, free
    labels = 0
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end += 2
        labels += 1
        while end < n and text[end] in LABEL:
            end += 1
    return ((start, end), end) if labels else (None, free)


def ip_at(text: str, dot: int, free: int) -> tuple[Span | None, int]:
    """The four numbers whose first dot is at `dot`."""
    start = dot
    while start > free and text[start - 1] in DIGITS:
        start -= 1
    if start == dot:
        return None, free
    n, at, parts = len(text), dot, [text[start:dot]]
    for _ in range(3):
        if not (at + 1 < n and text[at] == "." and text[at + 1] in DIGITS):
            return None, free
        end = at + 1
        while end < n and text[end] in DIGITS:
            end += 1
        parts.append(text[at + 1 : end])
        at = end
    right = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)
    return ((start, at) if right else None), at


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def card_at(text: str, at: int, free: int) -> tuple[Span | None, int]:
    """The run of digits, single spaces or hyphens between them, that starts at `at`."""
    if at < free:
        return None, free
    n, end, count = len(text), at + 1, 1
    while end < n:
        step = 1 if text[end] in DIGITS else 2 if text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS else 0
        if not step:
            break
        end += step
        count += 1
    if count < 2:
        return None, free
    right = 14 <= count <= 19 and luhn("".join(x for x in text[at:end] if x in DIGITS))
    return ((at, end) if right else None), end


def phone_at(text: str, plus: int, free: int) -> tuple[Span | None, int]:
    """The number after the plus sign at `plus`."""
    if plus < free or plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None, free
    end = plus + 2
    while end < len(text) and text[end] in DIALLED:
        end += 1
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3:
        return None, free
    right = 10 <= sum(x in DIGITS for x in text[plus:end]) <= 15
    return ((plus, end) if right else None), end


def url_at(text: str, colon: int, free: int) -> tuple[Span | None, int]:
    """The address around `://` at `colon`: a scheme of letters, then a host and whatever no blank or quote ends."""
    start = colon
    while start > free and text[start - 1] in LETTERS:
        start -= 1
    if start == colon:
        return None, free
    end = colon + 3
    while end < len(text) and text[end] not in ENDS_URL:
        end += 1
    while end > colon + 3 and text[end - 1] in ".,;:!?)*#&$%":
        end -= 1
    if end == colon + 3:
        return None, free
    return (start, end), end


def iban_right(value: str) -> bool:
    """Two letters, two check digits, letters and digits: the number they make leaves 1 when divided by 97."""
    if not (15 <= len(value) <= LONGEST_IBAN and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1


def _printed(text: str, start: int, end: int) -> int:
    """Where a value of letters and digits that starts at `start` ends if single blanks or hyphens part its printed groups.

    Groups are of capitals and digits and hold a digit each; the first ends at `end`. An IBAN ends where its
    check digits are right, and may have groups without a digit.
    """
    best, plain, n, digits = end, "", len(text), True
    at = start
    while True:
        stop = at
        while stop < n and stop - at < LONGEST_IBAN and (text[stop] in DIGITS or "A" <= text[stop] <= "Z"):
            stop += 1
        group = text[at:stop]
        plain += group
        if not group or len(plain) > LONGEST_IBAN or stop < n and text[stop] in SECRET and text[stop] != "-":
            return best
        if iban_right(plain):
            return stop
        digits = digits and any(x in DIGITS for x in group)
        best = max(best, stop) if digits else best
        if not (stop + 1 < n and text[stop] in " -"):
            return best
        at = stop + 1


def account_at(text: str, end_of_cue: int, free: int) -> tuple[Span | None, int]:
    """The value behind a cue: blanks, `:`, `=` or `#`, a quote, perhaps one of LINKS; then letters and digits, also in printed groups."""
    start, n = end_of_cue, len(text)
    if start >= n or text[start] not in " :=#\"'" or start < free:
        return None, free
    for _ in range(3):
        while start < n and text[start] in " :=#\"'":
            start += 1
        near = text[start : start + 8].lower()
        link = next((x for x in LINKS if near.startswith(x) and near[len(x) : len(x) + 1] in ("", " ", ":", "=", "#")), None)
        if not link:
            break
        start += len(link)
    end = start
    while end < n and text[end] in SECRET:
        end += 1
    if end == start:
        return None, max(free, start)  # the blanks and quotes before it hold no cue
    end = _printed(text, start, end)
    value = [x for x in text[start:end] if x in LETTERS or x in DIGITS]
    if len(value) < LEAST_VALUE or not any(x in DIGITS for x in value):
        return None, max(free, end)
    return (start, end), end


Parser = Callable[[str, int, int], tuple["Span | None", int]]
#: Parser and what to add to an anchor's end to get the place it starts from.
PARSERS: dict[str, tuple[Parser, int]] = {
    "email": (email_at, 0), "ip": (ip_at, -1), "card": (card_at, 0), "phone": (phone_at, -1), "url": (url_at, -2), "account": (account_at, 1),
}


def anchors() -> ahocorasick.Automaton:
    found: dict[str, list[str]] = {"@": ["email"], "://": ["url"]}
    for digit in sorted(DIGITS):
        found.setdefault(digit, []).append("card")
        found.setdefault("." + digit, []).append("ip")
        found.setdefault("+" + digit, []).append("phone")
    for cue in CUES:
        found.setdefault(cue, []).append("account")
    automaton = ahocorasick.Automaton()
    for word, kinds in found.items():
        automaton.add_word(word, [(KINDS.index(kind), *PARSERS[kind]) for kind in kinds])
    automaton.make_automaton()
    return automaton


_AUTOMATON: list[ahocorasick.Automaton] = []


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of all personal data, in this order; code points, end exclusive."""
    if not _AUTOMATON:
        _AUTOMATON.append(anchors())
    free, spans = [0] * len(KINDS), []
    lower = text.lower()
    if len(lower) != len(text):  # some letters have longer small forms
        lower = "".join(x.lower() if len(x.lower()) == 1 else x for x in text)
    for end, hits in _AUTOMATON[0].iter(lower):
        for kind, parser, shift in hits:
            span, free[kind] = parser(text, end + shift, free[kind])
            if span:
                spans.append((span[0], kind, span[1]))
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or union of overlapping spans, becomes the mark of its first kind, such as <EMAIL>."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> and redacted text of each row of docs.

    Whole texts; a null text counts as empty and comes back empty. Repeated rows give repeated
    results, an empty table an empty result; other columns are ignored. No shuffle.
    """

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [find_spans(x) for x in texts]
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, kind), pa.array(map(redact, texts, found), pa.string())],
                ["doc_id", "spans", "redacted"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, redacted string"
    )


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with redacted texts, all other columns as they are; a null text stays null. Cases as above."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [x if x is None else redact(x, find_spans(x)) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(giving_back(run), docs.schema)


def personal_data_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, base_sha256, spans (all of them, joined) and counts of the added kinds; cases as above."""

    def run(batches):
        names = ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans", *(f"n_{kind}" for kind in KINDS[len(BASE) :])]
        for batch in batches:
            found = [find_spans(x or "") for x in batch.column(1).to_pylist()]
            base = [[s for s in x if s[1] < len(BASE)] for x in found]
            counts = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts[: len(BASE)], pa.array(digests, pa.string()), pa.array(map(_joined, found), pa.string()), *counts[len(BASE) :]], names
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long"
    )
