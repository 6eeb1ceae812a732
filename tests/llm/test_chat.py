import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from hertzlake.llm import chat

PARTS = st.lists(st.sampled_from(["\\", "### ", "</turn>", ": ", "x", "y", "\n", "é"]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd: ### role", ""]), PARTS), max_size=6))
def test_round_trip(turns):
    found = chat.format_turns(turns, chat.Template())
    assert chat.read_back(found, chat.Template()) == turns and not found.rewrites
    assert found.text == chat.marked_turns(turns)


def test_templates_that_rewrite_history_are_found():
    counted = chat.Template(render=lambda turns: f"{len(turns)} turns\n" + "".join(f"[{role}] {text}\n" for role, text in turns))
    assert chat.format_turns([("u", "a"), ("u", "b")], counted).rewrites == [0, 1]
    last_only = chat.Template(render=lambda turns: "".join(f"[{r}]{t if k + 1 == len(turns) else '...'};" for k, (r, t) in enumerate(turns)))
    assert chat.format_turns([("u", "abc"), ("v", "d"), ("v", "e")], last_only).rewrites == [1, 2]


def test_spans_hold_for_the_last_output():
    counted = chat.Template(render=lambda turns: f"{len(turns)} turns\n" + "".join(f"[{role}] {text}\n" for role, text in turns), read_text=lambda t: t)
    turns = [("assistant" if k % 2 else "user", f"text{k}") for k in range(11)] + [("user", ""), ("assistant", "x")]
    found = chat.format_turns(turns, counted)
    assert found.rewrites and [found.text[b:c] for _, b, c, _ in found.spans] == [text for _, text in turns]
    last_only = chat.Template(render=lambda turns: "".join(f"[{r}]{t if k + 1 == len(turns) else '...'};" for k, (r, t) in enumerate(turns)), read_text=lambda t: t)
    found = chat.format_turns([("u", "abc"), ("v", "..."), ("v", "e")], last_only)
    assert found.text == "[u]...;[v]...;[v]e;" and found.spans == [(None,) * 4, (None,) * 4, (None, 17, 18, None)]


def test_loss_of_a_template_that_rewrites(spark):
    counted = chat.Template(render=lambda turns: f"{len(turns)} turns\n" + "".join(f"[{role}] {text}\n" for role, text in turns), read_text=lambda t: t)
    rows = [(1, k, "assistant" if k % 2 else "user", f"text{k}") for k in range(12)]
    found = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), counted).first()
    said = "".join(t for _, _, role, t in rows if role == "assistant")
    assert found.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and found.loss_chars == len(said) and found.n_turns == 12
    assert "".join(found.formatted[x.start : x.end] for x in found.loss_spans) == said and found.spans[0].start is None


def test_another_black_box_is_located():
    plain = chat.Template(render=lambda turns: "".join(f"<{role}>{text}</{role}>" for role, text in turns), read_role=lambda h: h[1:-1], read_text=lambda t: t)
    turns = [("system", "be x"), ("user", ""), ("assistant", "xy yx")]
    found = chat.format_turns(turns, plain)
    assert chat.read_back(found, plain) == turns and [found.text[b:c] for _, b, c, _ in found.spans] == ["be x", "", "xy yx"]


def test_cases(spark):
    rows = [(1, 1, "assistant", None, "e"), (1, 0, None, "hi", "e"), (1, 0, "user", "hi", "e"), (1, 0, "user", "hi", "e"), (None, None, "assistant", "z" * 200_000, "e"), (2, 5, "assistant", "a", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    found = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert found[1].n_turns == 4 and found[1].loss_chars == 0 and found[None].loss_chars == 200_000
    expected = "\nhi\nuser\nhi\nuser\nhi\nassistant\n\n"
    assert found[1].turns_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    assert found[2].formatted[found[2].loss_spans[0].start : found[2].loss_spans[0].end] == "a"
    assert chat.format_conversations(turns.limit(0)).count() == 0
