"""Chat formatting: a state machine over roles, a declarative template, loss flags per segment."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns look and which of them a model learns from.

    ``roles`` give the strings around a turn's text and whether the text counts
    for the loss; other roles use ``other``, with their name between the first
    two strings. ``moves`` is the state machine: state, role, next state.
    """

    roles: Mapping[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("<sys>", "</sys>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("<role>", "<text>", "</text>")
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered",)

    @cached_property
    def controls(self) -> list[str]:
        found = {s for o, c, _ in self.roles.values() for s in (o, c)} | set(self.other)
        for s in found:
            if len(s) < 2 or ESCAPE in s or any(t[0] in s[1:] for t in found):
                raise ValueError(f"control string {s!r}: two characters or more, the first ones only at the start")
        return sorted(found, key=len, reverse=True)

    @cached_property
    def _escaping(self) -> re.Pattern[str]:
        return re.compile("|".join([re.escape(ESCAPE), *map(re.escape, self.controls)]))

    @cached_property
    def _reading(self) -> re.Pattern[str]:
        return re.compile("|".join(map(re.escape, self.controls)))

    def escape(self, text: str) -> str:
        """Text in which no control string stands: each gets ESCAPE after its first character; ESCAPE is doubled."""
        return self._escaping.sub(
            lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def check(self, roles: list[str]) -> str | None:
        """None, or the first turn that the state machine refuses."""
        state = "start"
        for i, role in enumerate(roles):
            after = self.moves.get(state, {}).get(role)
            if after is None:
                return f"turn {i}: {role} in state {state}"
            state = after
        return None if state in self.final else f"ends in state {state}"

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """The formatted conversation as pieces of text, each with its loss flag."""
        out: list[tuple[str, bool]] = []
        for role, text in turns:
            if role in self.roles:
                before, after, loss = self.roles[role]
                out += [(before, False), (self.escape(text), loss), (after, False)]
            else:
                name, middle, after = self.other
                out += [(name + self.escape(role) + middle, False), (self.escape(text), False), (after, False)]
        return [s for s in out if s[0]]

    def read(self, formatted: str) -> list[tuple[str, str, bool]]:
        """Role, text and loss flag of every turn of a formatted conversation."""
        opening = {o: (r, c, loss) for r, (o, c, loss) in self.roles.items()}
        found, at, out = list(self._reading.finditer(formatted)), 0, []
        while at < len(found):
            mark = found[at]
            if mark[0] in opening:
                role, closing, loss = opening[mark[0]]
            else:
                role, closing, loss = self.unescape(formatted[mark.end():found[at + 1].start()]), self.other[2], False
                at += 1
            end = found[at + 1]
            if end[0] != closing:
                raise ValueError(f"{closing!r} expected at {end.start()}")
            out.append((role, self.unescape(formatted[found[at].end():end.start()]), loss))
            at += 2
        return out


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """``conv_id, formatted, segments, valid, problem``: one row per conversation.

    Rows are turns (``conv_id, turn, role, text``), ordered by turn, ties by role
    and text, null turns first; null roles and texts are empty, a null id is one
    conversation. Every turn is formatted, also of conversations whose order the
    state machine refuses: those are not ``valid`` and ``problem`` names the
    turn. ``segments`` joined are ``formatted``. No rows give no rows. A
    conversation is one row of the result and so has to fit a task.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = turns.select(F.col("conv_id"), F.struct(
        F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    kind = whole.schema["conv_id"].dataType.simpleString()
    grouped = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    pieces = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                turns_ = [list(zip(r, t, strict=True)) for r, t in zip(
                    part.column("roles").to_pylist(), part.column("texts").to_pylist(), strict=True)]
                made = [template.segments(t) for t in turns_]
                problems = [template.check([r for r, _ in t]) for t in turns_]
                yield pa.RecordBatch.from_arrays([
                    part.column("conv_id"), pa.array(["".join(s for s, _ in m) for m in made], pa.string()),
                    pa.array([[{"text": s, "loss": x} for s, x in m] for m in made], pieces),
                    pa.array([p is None for p in problems]), pa.array(problems, pa.string()),
                ], ["conv_id", "formatted", "segments", "valid", "problem"])

    return grouped.mapInArrow(
        formatted, f"conv_id {kind}, formatted string, segments {SEGMENTS}, valid boolean, problem string")


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Digests of formatted conversations, taken from ``formatted`` and ``segments`` alone.

    ``n_turns``; ``turns_sha256`` of role, line feed, text, line feed per turn;
    ``loss_chars`` and ``loss_sha256`` of the unescaped text under the loss flags;
    ``formatted_chars``.
    """
    kind = chats.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for formatted, segments in zip(batch.column("formatted").to_pylist(),
                                           batch.column("segments").to_pylist(), strict=True):
                turns = template.read(formatted)
                loss = "".join(template.unescape(s["text"]) for s in segments if s["loss"])
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _ in turns)),
                             len(loss), sha(loss), len(formatted)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *columns, batch.column("valid")],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return chats.select("conv_id", "formatted", "segments", "valid").mapInArrow(
        digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                "loss_sha256 string, formatted_chars bigint, valid boolean")
