"""Chat formatting through a template that is a black box.

The template only maps a list of turns to a string. The formatter renders the conversation's
successive prefixes and compares each output with the one before: what is new is the turn's span.
Two more renderings, with the turn's text replaced by either of two probe letters, tell the turn's
text from its header and trailer, as they agree everywhere else. An output that doesn't start with
the one before comes from a template that rewrites history; then spans of earlier outputs say nothing
of the last one, and all texts are located again, by probes in the whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
ESCAPES = (("\\", "\\\\"), ("### ", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
_PLAIN = {after: before for before, after in ESCAPES}


def escape(text: str) -> str:
    """Control strings of the marked template, and the escape sign itself, as two-character codes."""
    for before, after in ESCAPES:
        text = text.replace(before, after)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda code: _PLAIN[code[0]], text)


@lru_cache(512)
def _marked_turn(turn: Turn) -> str:
    return f"### {escape(turn[0])}: {escape(turn[1])}</turn>\n"


def marked_turns(turns: list[Turn]) -> str:
    """`### role: text</turn>` and a line end for each turn, roles and texts escaped."""
    return "".join(map(_marked_turn, turns))


def marked_role(header: str) -> str:
    return unescape(header[len("### ") : -len(": ")])


@dataclass(frozen=True)
class Template:
    """render is a black box; read_role and read_text undo what it does to a role's header and a text."""

    render: Callable[[list[Turn]], str] = marked_turns
    read_role: Callable[[str], str] = marked_role
    read_text: Callable[[str], str] = unescape
    probes: tuple[str, str] = ("x", "y")


@dataclass
class Formatted:
    text: str = ""
    #: (start of the turn, start of its text, end of its text, end of the turn), code points of text. Where
    #: history is rewritten, the turn's own ends are None, and all is None for a text that text doesn't show.
    spans: list[tuple[int | None, int | None, int | None, int | None]] = field(default_factory=list)
    #: Turns whose output doesn't start with the output before.
    rewrites: list[int] = field(default_factory=list)


def _common(one: str, other: str) -> int:
    """Length of the common start, by halving: whole slices are compared, not single characters."""
    low, high = 0, min(len(one), len(other))
    while low < high:
        middle = (low + high + 1) // 2
        if one[low:middle] == other[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _split(before: str, one: str, other: str) -> tuple[int, int]:
    """Lengths of the common head and the common tail of two renderings that differ in one probe.

    Both mostly start with the output before; then only what follows is compared.
    """
    known = len(before) if one.startswith(before) and other.startswith(before) else 0
    one, other = one[known:], other[known:]
    head = _common(one, other)
    return known + head, _common(one[head:][::-1], other[head:][::-1])


def _located(turns: list[Turn], output: str, template: Template) -> list[tuple[int | None, int | None, int | None, int | None]]:
    """The place of each turn's text in the last output: where whole conversations with a probe for it differ."""
    spans: list[tuple[int | None, int | None, int | None, int | None]] = []
    for k, (role, text) in enumerate(turns):
        one, other = (template.render([*turns[:k], (role, probe), *turns[k + 1 :]]) for probe in template.probes)
        head, tail = _split("", one, other)
        end = len(output) - tail
        shown = one != other and head <= end and output[:head] == one[:head] and output[end:] == one[len(one) - tail :]
        spans.append((None, head, end, None) if shown and template.read_text(output[head:end]) == text else (None,) * 4)
    return spans


def format_turns(turns: list[Turn], template: Template) -> Formatted:
    """The rendered conversation and each turn's place in it.

    All spans hold for the last output.
    """
    found, before = Formatted(), template.render([])
    if not turns:
        found.text = before
    for k, (role, _) in enumerate(turns):
        prefix = turns[:k]
        output = template.render(turns[: k + 1])
        if not output.startswith(before):
            found.rewrites.append(k)
        if not found.rewrites:
            head, tail = _split(before, *(template.render([*prefix, (role, probe)]) for probe in template.probes))
            found.spans.append((len(before), head, len(output) - tail, len(output)))
        found.text = before = output
    if found.rewrites:
        found.spans = _located(turns, found.text, template)
    return found


def read_back(found: Formatted, template: Template) -> list[tuple[str | None, str | None]]:
    """Roles and texts, from the rendered text and the spans alone; None where the spans are."""
    return [
        (None if start is None else template.read_role(found.text[start:head]), None if head is None else template.read_text(found.text[head:tail]))
        for start, head, tail, _ in found.spans
    ]


def _conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation, with its turns in order: by turn, then role, then text."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    return clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_conversations(turns: DataFrame, template: Template = Template(), loss_role: str = "assistant") -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text).

    conv_id, n_turns, formatted string, spans array<struct<start,text_start,text_end,end>>, loss_spans
    array<struct<start,end>> (the places of loss_role's texts), rewrites array<int>, and, read back from
    formatted: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A template that rewrites
    history has null starts and ends of turns, roles as given, and null spans of texts that its last output
    doesn't show; such texts are not under the loss mask and count as empty in turns_sha256.

    A null text or role counts as empty, a null turn comes first, equal turn numbers are ordered by role
    and text, repeated rows are turns of their own, a null conv_id is a conversation. An empty table
    gives an empty result; other columns are ignored. One shuffle by conv_id. A conversation is one
    task's work, as it is one string; its renderings cost the square of its turns, its memory is linear.
    """
    span = "struct<start:long,text_start:long,text_end:long,end:long>"
    schema = (
        f"conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        f"formatted_chars long, formatted string, spans array<{span}>, loss_spans array<struct<start:long,end:long>>, rewrites array<int>"
    )
    kinds = [
        pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
        pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "text_start", "text_end", "end")])),
        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int32()),
    ]
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", schema)]

    def one(conv_id: int | None, turns: list[dict]) -> tuple:
        found = format_turns([(x["role"], x["text"]) for x in turns], template)
        again = [(x["role"] if role is None else role, text or "") for x, (role, text) in zip(turns, read_back(found, template))]
        loss = [(head, tail) for (role, _), (_, head, tail, _) in zip(again, found.spans) if role == loss_role and head is not None]
        said = "".join(template.read_text(found.text[head:tail]) for head, tail in loss)
        every = "".join(f"{role}\n{text}\n" for role, text in again)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        spans = [dict(zip(("start", "text_start", "text_end", "end"), x)) for x in found.spans]
        return (
            conv_id, len(again), sha(every), len(said), sha(said), len(found.text), found.text, spans,
            [{"start": a, "end": b} for a, b in loss], found.rewrites,
        )

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [one(*x) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    return _conversations(turns).mapInArrow(run, schema)
