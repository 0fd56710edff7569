"""Chat formatting: a finite-state machine over roles emits text segments with loss flags.

A declarative `Template` gives each role the strings before and after its text and says
whether the text is under the loss. Control strings inside texts are escaped by a
backslash after their first character (and one more where backslashes stand there
already), so no text can end a turn, and unescaping gives the text back exactly.

The machine's state is the role of the turn before; `FOLLOWS` lists the roles that may
come next. A conversation that breaks the order is still formatted whole and is marked
by `turn_ok` false at the turn in question.

Turns are dealt by conversation and sorted by (turn, role, text), so a task streams
through its conversations turn by turn: the memory it needs is one turn, however long a
conversation is. Defined cases: a null text is empty; a null or unknown role is written
with the generic marks and is out of order; a null conv_id or turn sorts first and is a
conversation or turn like any other; repeated rows are turns of their own; an empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.base import materialize


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """roles: marks and loss by role. other: marks of roles that are not listed, whose
    (escaped) name stands between `other_open` and `other_close`."""

    roles: dict[str, Role]
    other_open: str
    other_close: str
    other_after: str

    @property
    def controls(self) -> tuple[str, ...]:
        marks = {x.strip() for r in self.roles.values() for x in (r.before, r.after)} | {self.other_open.strip(), self.other_close.strip(), self.other_after.strip()}
        return tuple(sorted(marks - {""}, key=lambda x: (-len(x), x)))


#: Every role has marks of its own, so that any order of turns can be read back.
INSTRUCT = Template(
    {"system": Role("<<SYS>>\n", "\n<</SYS>>\n", False), "user": Role("[INST] ", " [/INST]", False), "assistant": Role("<s> ", "</s>", True)},
    "<|role|>",
    "<|text|>",
    "<|done|>",
)
#: state (None: start) -> roles that may follow.
FOLLOWS: dict[str | None, frozenset[str]] = {
    None: frozenset({"system", "user"}),
    "system": frozenset({"user"}),
    "user": frozenset({"assistant"}),
    "assistant": frozenset({"user"}),
}
SEGMENTS = "conv_id long, turn_no long, turn_ok boolean, segments array<struct<text: string, loss: boolean>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, order_ok boolean"


class Codec:
    """Escaping and parsing under one template."""

    def __init__(self, template: Template):
        self.template, controls = template, template.controls
        self.bare = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in controls))
        self.held = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in controls))
        opens = {r.before: name for name, r in template.roles.items()}
        self.opens = sorted(opens.items(), key=lambda x: -len(x[0]))

    @staticmethod
    def _parts(m: re.Match) -> tuple[str, str, str]:
        first = m.lastindex - 2
        return m.group(first), m.group(first + 1), m.group(first + 2)

    def escape(self, text: str) -> str:
        return self.bare.sub(lambda m: "{0}\\{1}{2}".format(*self._parts(m)), text)

    def unescape(self, text: str) -> str:
        return self.held.sub(lambda m: "".join(self._parts(m)), text)

    def segments(self, role: str | None, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn; the text is one segment of its own."""
        t = self.template
        if r := t.roles.get(role):
            return [(r.before, False), (self.escape(text), r.loss), (r.after, False)]
        named = "" if role is None else "=" + self.escape(role)
        return [(t.other_open + named + t.other_close, False), (self.escape(text), False), (t.other_after, False)]

    def parse(self, formatted: str) -> tuple[str | None, str]:
        """(role, text) of one formatted turn."""
        t = self.template
        for before, role in self.opens:
            if formatted.startswith(before) and formatted.endswith(t.roles[role].after):
                return role, self.unescape(formatted[len(before) : len(formatted) - len(t.roles[role].after)])
        if not (formatted.startswith(t.other_open) and formatted.endswith(t.other_after)):
            raise ValueError("not a formatted turn")
        name, _, text = formatted[len(t.other_open) :].partition(t.other_close)
        return (self.unescape(name[1:]) if name else None), self.unescape(text[: len(text) - len(t.other_after)])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _rows(rows: Iterator[tuple], schema: pa.Schema, characters: int = 1 << 22, count: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size. The first item of a row is its weight in characters."""
    held, weight = [], 0
    for own, *row in rows:
        held.append(row)
        weight += own
        if weight >= characters or len(held) >= count:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_turns(conversations: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn_no (0-based, gapless), turn_ok, segments."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("turn_ok", pa.bool_()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)

        def rows() -> Iterator[tuple]:
            at, number, state = object(), 0, None
            for conv_id, _, who, said in _stream(batches):
                if conv_id != at:
                    at, number, state = conv_id, 0, None
                made = codec.segments(who, said or "")
                yield sum(len(x) for x, _ in made), conv_id, number, who in FOLLOWS.get(state, ()), [{"text": x, "loss": f} for x, f in made]
                number, state = number + 1, who

        yield from _rows(rows(), schema)

    turns = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of what the segments of format_turns hold, one row per conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("order_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)

        def rows() -> Iterator[tuple]:
            at, held = object(), None
            for conv_id, _, ok, segments in _stream(batches):
                if conv_id != at:
                    if held:
                        yield close(at, held)
                    at, held = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                formatted = "".join(x["text"] for x in segments)
                who, said = codec.parse(formatted)
                held[0] += 1
                held[1].update(f"{'' if who is None else who}\n{said}\n".encode())
                for x in segments:
                    if x["loss"]:
                        plain = codec.unescape(x["text"])
                        held[2] += len(plain)
                        held[3].update(plain.encode())
                held[4] += len(formatted)
                held[5] &= ok
            if held:
                yield close(at, held)

        def close(conv_id: int | None, held: list) -> tuple:
            return 1, conv_id, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4], held[5]

        yield from _rows(rows(), schema)

    return formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn_no").mapInArrow(run, DIGESTS)


def format_and_read(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Format, write the segments to the shared folder, and read them back from there."""
    return read_back(materialize(format_turns(conversations, template), "chat"), template)
