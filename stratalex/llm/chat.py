"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """How turns are marked: role -> (opening, closing). ``other`` marks roles that have no entry; {} is the role."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>> ", " <</SYS>>"),
            "user": ("<s>[INST] ", " [/INST]"),
            "assistant": ("<a> ", " </s>"),
        }
    )
    other: tuple[str, str] = ("<role {}> ", " </role>")
    #: Strings that may not stand inside a text as they are.
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<a>", "<role ", "</role>")
    #: state -> role -> next state; a role that a state does not list breaks the order.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "open", "user": "asked"},
            "open": {"user": "asked"},
            "asked": {"assistant": "told"},
            "told": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("told",)
    learned: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        """``text`` with no control string: escape signs doubled, one put after the first sign of each control string."""
        if ESCAPE in text:
            text = text.replace(ESCAPE, ESCAPE * 2)
        for c in self.controls:
            if c in text:
                text = text.replace(c, c[0] + ESCAPE + c[1:])
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if ESCAPE in text else text

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments (text, under the loss mask) of one turn."""
        if role in self.marks:
            opening, closing = self.marks[role]
        else:
            # a role's own text may hold no closing sign of its mark
            opening = self.other[0].format(self.escape(role).replace(">", ">" + ESCAPE))
            closing = self.other[1]
        return [(opening, False), (self.escape(text), role in self.learned), (closing, False)]

    def pattern(self) -> re.Pattern:
        """One turn as it stands in formatted text. No control string is inside a text, so the first closing ends it."""
        parts = [f"{re.escape(o)}(?P<t{i}>.*?){re.escape(c)}" for i, (o, c) in enumerate(self.marks.values())]
        a, b = self.other[0].split("{}")
        parts.append(f"{re.escape(a)}(?P<role>(?:[^>]|>{re.escape(ESCAPE)})*){re.escape(b)}(?P<other>.*?){re.escape(self.other[1])}")
        return re.compile("|".join(f"(?:{p})" for p in parts), re.S)

    def read(self, match: re.Match) -> tuple[str, str]:
        """(role, text) of a match of ``pattern``."""
        for i, role in enumerate(self.marks):
            if match[f"t{i}"] is not None:
                return role, self.unescape(match[f"t{i}"])
        return self.unescape(match["role"].replace(">" + ESCAPE, ">")), self.unescape(match["other"])


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (conv_id, n, text, loss, valid) of ``turns`` (conv_id, turn, role, text), in order within each task.

    Turns are ordered by turn, then role, then text, nulls first; repeated rows
    are turns of their own. A null text or role is empty. ``valid`` says whether
    the order of roles is allowed up to and with this turn. A conversation is
    streamed, never held, so its length costs no memory. A null conv_id is one
    conversation. Other columns are not read.
    """
    own = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n, begun = None, "start", 0, False
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not begun or conv != last:
                    last, state, n, begun = conv, "start", 0, True
                state = own.moves.get(state, {}).get(role, "broken")
                for piece, loss in own.turn(role or "", text or ""):
                    out.append((conv, n, piece, loss, state != "broken"))
                    n += 1
            cols = zip(*out) if out else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n", "text", "loss", "valid"]
            )

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, n long, text string, loss boolean, valid boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, parsed from the formatted text alone and from its loss flags.

    ``segments`` as ``format_chats`` returns them, still in its order. Turns are
    parsed as soon as they are closed, so only an open turn is held.
    """
    own = template or Template()
    pattern = own.pattern()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    class Reader:
        def __init__(self, conv):
            self.conv, self.turns, self.sha, self.loss, self.loss_sha = conv, 0, hashlib.sha256(), 0, hashlib.sha256()
            self.chars, self.open, self.valid, self.role = 0, "", True, None

        def add(self, text, loss, valid):
            self.chars += len(text)
            self.valid &= valid
            if loss:
                plain = own.unescape(text)
                self.loss += len(plain)
                self.loss_sha.update(plain.encode())
            self.open += text
            m = pattern.match(self.open)
            while m and self.open:
                role, plain = own.read(m)
                self.role = role
                self.turns += 1
                self.sha.update(f"{role}\n{plain}\n".encode())
                self.open = self.open[m.end() :]
                m = pattern.match(self.open)

        def row(self):
            if self.open:
                raise ValueError(f"conversation {self.conv}: formatted text that no turn explains")
            ends = not self.turns or any(own.moves.get(s, {}).get(self.role) in own.final for s in own.moves)
            return self.conv, self.turns, self.sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars, self.valid and ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = []
            for conv, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid"))):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        out.append(reader.row())
                    reader = Reader(conv)
                reader.add(text, loss, valid)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 7, kinds)], names=names)
        if reader is not None:
            yield pa.record_batch([pa.array([v], k) for v, k in zip(reader.row(), kinds)], names=names)

    return segments.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean",
    )
