"""Chat formatting by a declarative template and a finite-state machine over roles.

The template gives each role an opening and a closing string and says which role is
learned. The machine reads the roles of a conversation in turn order and says whether
the order is valid. Every turn becomes segments (markers and texts) with a loss flag;
the text of a segment is escaped, so no control string can occur in it, and ``parse``
restores roles and texts from the formatted segments alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantaint.sources.store import keep


class Turn(NamedTuple):
    open: str
    close: str
    loss: bool = False


class Template(NamedTuple):
    """``turns`` by role; other roles take ``other``, where {} stands for the escaped role."""

    turns: dict[str, Turn]
    other: Turn
    escape: str
    # State -> role -> next state; "*" stands for any role that is not named.
    machine: dict[str, dict[str, str]]
    start: str
    accepting: frozenset[str]


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=Turn("<ROLE:{}|>", "</ROLE>"),
    escape="\\",
    machine={
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    accepting=frozenset({"answered"}),
)


class Formatter:
    """Turns to segments and back, under one template."""

    def __init__(self, template: Template = INSTRUCT):
        self.template = template
        head, tail = template.other.open.split("{}")
        markers = [x for t in template.turns.values() for x in (t.open, t.close)]
        markers += [head, tail, template.other.close]
        # Longest first, so that a marker that starts another one is not cut.
        ordered = sorted(markers, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, [template.escape, *ordered])))
        self._escaped = re.compile(re.escape(template.escape) + "(.)", re.DOTALL)
        turns = [
            f"{re.escape(t.open)}(?P<{role}>{self._body(t.close)}){re.escape(t.close)}"
            for role, t in template.turns.items()
        ]
        other = (
            f"{re.escape(head)}(?P<_role>{self._body(tail)}){re.escape(tail)}"
            f"(?P<_text>{self._body(template.other.close)}){re.escape(template.other.close)}"
        )
        self._turn = re.compile("|".join([*turns, other]), re.DOTALL)

    def _body(self, close: str) -> str:
        mark, first = re.escape(self.template.escape), re.escape(close[0])
        return f"(?:{mark}.|[^{mark}{first}]++|(?!{re.escape(close)}){first})*+"

    def escape(self, text: str) -> str:
        """Put the escape sign before itself and before every control string."""
        return self._special.sub(lambda m: self.template.escape + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        turn = self.template.turns.get(role)
        if turn is None:
            opened = self.template.other.open.replace("{}", self.escape(role))
            turn = self.template.other._replace(open=opened)
        return [(turn.open, False), (self.escape(text), turn.loss), (turn.close, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted text."""
        found, at = [], 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            groups = m.groupdict()
            if groups["_role"] is not None:
                found.append((self.unescape(groups["_role"]), self.unescape(groups["_text"])))
            else:
                role = next(r for r in self.template.turns if groups[r] is not None)
                found.append((role, self.unescape(groups[role])))
            at = m.end()
        return found


class Machine:
    """Reads roles; ``ok`` says whether the conversation may end here."""

    def __init__(self, template: Template = INSTRUCT):
        self._template = template
        self.state: str | None = template.start

    def read(self, role: str) -> None:
        edges = self._template.machine.get(self.state, {}) if self.state else {}
        self.state = edges.get(role, edges.get("*"))

    @property
    def ok(self) -> bool:
        return self.state in self._template.accepting


_SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, state string"
_SHOWN = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of all conversations: (conv_id, turn_no, segment, text, loss, state).

    Turns are ordered by ``turn`` (nulls first), equal ones by role and text, and numbered
    from 0. Null roles and texts count as empty. Conversations whose turn order is invalid are
    formatted like the others; ``state`` is the machine's state after the turn, null once it
    is lost. A null ``conv_id`` is one conversation. Rows are streamed, so a conversation of
    any length needs the memory of one batch.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        at: object = run
        machine, number = Machine(template), 0
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conv, role, text in zip(*columns, strict=True):
                if conv != at:
                    at, machine, number = conv, Machine(template), 0
                machine.read(role)
                for i, (piece, loss) in enumerate(formatter.segments(role, text)):
                    out.append((conv, number, i, piece, loss, machine.state))
                number += 1
            yield _batch(out, _SEGMENTS)

    return ordered.mapInArrow(run, _SEGMENTS)


def digest_segments(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the formatted output says: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid).

    Roles and texts are parsed back from the segments of each turn; the learned text is what
    lies under the loss flag, unescaped. Digests are fed turn by turn.
    """
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "segment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(template)
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "text", "loss", "state"))
            for row in zip(*columns, strict=True):
                out.extend(reader.feed(*row))
            if out:
                yield _batch(out, _SHOWN)
        if rest := reader.end():
            yield _batch(rest, _SHOWN)

    return ordered.mapInArrow(run, _SHOWN)


class _Reader:
    def __init__(self, template: Template):
        self._template, self._formatter = template, Formatter(template)
        self._conv: object = self
        self._turn: list[str] = []
        self._turn_no = -1

    def feed(self, conv, turn_no, text, loss, state) -> list[tuple]:
        done: list[tuple] = []
        if conv != self._conv:
            done = self.end()
            self._conv, self._turn_no = conv, -1
            self._n = self._loss_chars = self._chars = 0
            self._all, self._learned = hashlib.sha256(), hashlib.sha256()
        if turn_no != self._turn_no:
            self._close_turn()
            self._turn_no = turn_no
        self._turn.append(text)
        self._chars += len(text)
        self._state = state
        if loss:
            plain = self._formatter.unescape(text)
            self._loss_chars += len(plain)
            self._learned.update(plain.encode())
        return done

    def _close_turn(self) -> None:
        if self._turn:
            for role, text in self._formatter.parse("".join(self._turn)):
                self._all.update(f"{role}\n{text}\n".encode())
                self._n += 1
            self._turn = []

    def end(self) -> list[tuple]:
        if self._conv is self:
            return []
        self._close_turn()
        return [
            (
                self._conv,
                self._n,
                self._all.hexdigest(),
                self._loss_chars,
                self._learned.hexdigest(),
                self._chars,
                self._state in self._template.accepting,
            )
        ]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def chat_digests(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Format, store and read back; an empty table gives no rows."""
    return digest_segments(keep(format_conversations(conversations, template), "chat-segments"), template)
