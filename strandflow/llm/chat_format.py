r"""Chat formatting with typed content parts.

A turn's content is a text, or a list of parts of type text, image, audio or document. A visitor flattens the
parts in order: texts are escaped and joined, every other part leaves a placeholder ``<|image|>``,
``<|audio|>`` or ``<|document|>`` and an attachment: its kind, its reference and the tokens that it expands to.

The template puts ``<|turn|>role`` and a line feed before each turn and ``<|end|>`` and a line feed after it. Control
strings inside texts (those that begin with ``<|``, and ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, which other
templates use) get a backslash after their first character, one more if some are there already; taking one
away again gives the text back. The loss mask lists (start, stop) code point spans of the output: the
assistant's texts, without placeholders.

Turns are flattened before they are grouped. Only the finished turns of one conversation meet, as they make
one row of output; the order is turn (null first), then role, then text.

Inputs: null texts and roles are empty, unknown part types are kept as documents, a null conversation id is
a conversation of its own, repeated rows are turns of their own; an empty table gives an empty result; other
columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TURN, END = "<|turn|>", "<|end|>\n"
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")
_PLACE = re.compile(r"<\|(?:image|audio|document)\|>")

#: A content part. Sizes may be null; see Flatten for what they then expand to.
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
_ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_FLAT = "conv_id long, turn long, role string, body string, attachments array<struct<kind: string, ref: string, tokens: bigint>>"
FORMATTED = "conv_id long, formatted string, loss array<struct<start: bigint, stop: bigint>>, attachments array<struct<kind: string, ref: string, tokens: bigint>>, expanded_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role(role: str | None) -> str:
    return (role or "").replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\|")


def _role_back(role: str) -> str:
    return re.sub(r"<\\\||\\n|\\\\", lambda m: {"<\\|": "<|", "\\n": "\n", "\\\\": "\\"}[m[0]], role)


class Flatten:
    """Visits the parts of one content in order. Neighbouring texts are one text, so that no control string can
    come about where they meet."""

    PATCH, AUDIO_RATE, PAGE = 28, 25, 560

    def __init__(self) -> None:
        self.body: list[str] = []
        self.text: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def flattened(self) -> str:
        self._end_text()
        return "".join(self.body)

    def _end_text(self) -> None:
        self.body.append(escape("".join(self.text)))
        self.text.clear()

    def visit_image(self, part: dict) -> None:
        patches = [math.ceil(max(1, part.get(side) or 16 * self.PATCH) / self.PATCH) for side in ("width", "height")]
        self._attach("image", part, patches[0] * patches[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(0.0, part.get("seconds") or 0.0) * self.AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.PAGE)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._end_text()
        self.body.append(f"<|{kind}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, attachments = [], []
        for content in batch.column(3).to_pylist():
            visitor = Flatten()
            for part in [{"type": "text", "text": content}] if isinstance(content, str | None) else content:
                if part is not None:
                    visitor.visit(part)
            bodies.append(visitor.flattened())
            attachments.append(visitor.attachments)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.string()), pa.array(attachments, pa.list_(_ATTACHMENT))], names=["conv_id", "turn", "role", "body", "attachments"])


def render(turns: list[dict]) -> tuple[str, list[dict]]:
    """The formatted conversation and its loss spans."""
    out, at, loss = [], 0, []
    for t in turns:
        head = f"{TURN}{_role(t['role'])}\n"
        at += len(head)
        if t["role"] == "assistant":
            begin = 0
            for hole in [*((m.start(), m.end()) for m in _PLACE.finditer(t["body"])), (len(t["body"]),) * 2]:
                if hole[0] > begin:
                    loss.append({"start": at + begin, "stop": at + hole[0]})
                begin = hole[1]
        out += [head, t["body"], END]
        at += len(t["body"]) + len(END)
    return "".join(out), loss


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            turns = batch.column(1).to_pylist()
            made = [render(t) for t in turns]
            kept = [[a for t in own for a in t["attachments"]] for own in turns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], spans), pa.array(kept, pa.list_(_ATTACHMENT)), pa.array([sum(a["tokens"] for a in own) for own in kept], pa.int64())],
                names=["conv_id", "formatted", "loss", "attachments", "expanded_tokens"],
            )


def format_chats(turns: DataFrame, content: str = "text", conv_id: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row per conversation, with the columns of ``FORMATTED``. ``content`` is a string or an array of
    ``PART``."""
    kind = turns.schema[content].dataType
    body = F.col(content) if isinstance(kind, T.ArrayType) else F.col(content).cast("string")
    flat = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), body.alias("content")).mapInArrow(_flatten, _FLAT)
    grouped = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attachments"))).alias("turns"))
    return grouped.mapInArrow(_render, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay in the text."""
    turns = []
    for block in formatted.split(END)[:-1]:
        role, _, body = block.removeprefix(TURN).partition("\n")
        turns.append((_role_back(role), unescape(body)))
    return turns


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            turns = parse(formatted)
            said = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in loss)
            rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in READ.split(", ")])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, and one whose texts are control strings; digests are read back from the output."""
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_chats(turns.unionByName(own)).select("conv_id", "formatted", "loss").mapInArrow(_read, READ)


QUERIES = {"op7_chat_format": op7_chat_format}
SQL = {
    "op7_chat_format": r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') as body from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|turn|>') + length(role) + 1 + length(body) + length('<|end|>') + 1)::bigint as formatted_chars
from e group by conv_id
""",
}
