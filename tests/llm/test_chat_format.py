from __future__ import annotations

from hypothesis import given, settings, strategies as st

from strandflow.llm.chat_format import PART, SQL, Flatten, escape, format_chats, op7_chat_format, parse, render, unescape
from tests.conftest import SF, rows_of


def test_query_equals_sql(spark, duck):
    assert rows_of(op7_chat_format(spark, SF)) == rows_of(duck.sql(SQL["op7_chat_format"]).df())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|", "<\\|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "\n", "end", "turn", "a", "é", "image"]), max_size=14).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    out = escape(text)
    assert unescape(out) == text
    assert not any(x in out for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", "|end|>\n<", "|turn|>assistant\nx", "<|", "<\\|", "image|>", "|image|>", "[", "/INST]", "\\", "s>", None, "IMAGE"]), max_size=8))
def test_parts_forge_no_turn_and_no_placeholder(parts):
    visitor = Flatten()
    for x in parts:
        visitor.visit({"type": "image"} if x == "IMAGE" else {"type": "text", "text": x})
    body = visitor.flattened()
    formatted, loss = render([{"role": "assistant", "body": body}])
    assert body.count("<|") == len(visitor.attachments) == parts.count("IMAGE")
    assert "".join(unescape(formatted[s["start"] : s["stop"]]) for s in loss) == "".join(x or "" for x in parts if x != "IMAGE")
    assert [unescape(x) for x in body.split("<|image|>")] == ["".join(y or "" for y in run) for run in split(parts)]
    assert len(parse(formatted)) == 1


def split(parts: list) -> list[list]:
    out = [[]]
    for x in parts:
        if x == "IMAGE":
            out.append([])
        else:
            out[-1].append(x)
    return out


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [
        (1, 1, "assistant", [part("text", text="It is <|image|> "), part("image", ref="made.png", width=29, height=56), part("text", text=" done")]),
        (1, 0, "user", [part("text", text="See "), part("image", ref="a.png", width=280, height=28), part("audio", ref="b.wav", seconds=2.01), part("document", ref="c.pdf", pages=3), None, part("video", ref="d")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, text array<{PART}>")
    r = format_chats(df).first()
    assert r["formatted"] == "<|turn|>user\nSee <|image|><|audio|><|document|><|document|><|end|>\n<|turn|>assistant\nIt is <\\|image|> <|image|> done<|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 10), ("audio", "b.wav", 51), ("document", "c.pdf", 1680), ("document", "d", 560), ("image", "made.png", 4)]
    assert r["expanded_tokens"] == 10 + 51 + 1680 + 560 + 4
    assert [unescape(r["formatted"][s["start"] : s["stop"]]) for s in r["loss"]] == ["It is <|image|> ", " done"]


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user\nx<|", "first"), (None, 1, "assistant", "alone"), (None, 1, "assistant", "alone"), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in format_chats(df).collect()}
    assert parse(got[1]["formatted"]) == [("user\nx<|", "first"), ("", ""), ("user", "a"), ("user", "b")]
    assert parse(got[None]["formatted"]) == [("assistant", "alone")] * 2 and len(got[None]["loss"]) == 2
    assert got[3]["loss"] == []
    assert format_chats(df.limit(0)).collect() == []
