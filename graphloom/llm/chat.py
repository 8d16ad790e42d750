"""Chat formatting (operator 5): a finite-state machine over roles, a declarative template, loss flags by segment.

A conversation's rows, in the order of (turn, role, text), become segments: an opening marker, the text and a closing
marker for each turn. Control strings inside a text are escaped, so the formatted string can be read back exactly.
Turn order is validated, not enforced: turns that the machine doesn't allow are formatted as well, and flagged.

Null role or text: empty. Roles that the template doesn't name are written with their name between markers. Repeated
rows are turns of their own. The state for an open conversation is a few strings, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import width


@dataclass(frozen=True)
class Template:
    """markers: role -> (open, close, whether its text is under the loss). after: state -> roles that may follow."""

    markers: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    after: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    @property
    def controls(self) -> list[str]:
        return sorted({m for o, c, _ in self.markers.values() for m in (o, c)} | set(self.other), key=lambda m: (-len(m), m))


class Codec:
    """Escapes by a backslash after the first character of a control string; a backslash itself is doubled."""

    def __init__(self, template: Template):
        self.t = template
        self.control = re.compile("(?=" + "|".join(map(re.escape, template.controls)) + ")(.)", re.S)

    def escape(self, text: str) -> str:
        return self.control.sub(r"\1\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(kind, string, loss) of one turn."""
        if role in self.t.markers:
            start, end, loss = self.t.markers[role]
        else:
            (start, mid, end), loss = self.t.other, False
            start = f"{start}{self.escape(role)}{mid}"
        return [("open", start, False), ("text", self.escape(text), loss), ("close", end, False)]

    def read(self, buffer: str) -> tuple[list[tuple[str, str]], str]:
        """The whole turns at the start of a formatted string, and the rest."""
        turns = []
        while buffer:
            for role, (start, end, _) in self.t.markers.items():
                if buffer.startswith(start):
                    name, at = role, len(start)
                    break
            else:
                start, mid, end = self.t.other
                if not buffer.startswith(start) or (k := buffer.find(mid)) < 0:
                    break
                name, at = self.unescape(buffer[len(start) : k]), k + len(mid)
            if (k := buffer.find(end, at)) < 0:
                break
            turns.append((name, self.unescape(buffer[at:k])))
            buffer = buffer[k + len(end) :]
        return turns, buffer


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of each conversation, in order within a partition: conv_id, segment, turn_index, kind, text, loss, allowed.

    ``allowed`` is false in the segments of a turn that may not follow the one before it.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, state, turn, n, first = Codec(template), None, "", 0, 0, True
        for b in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if first or conv != now:
                    now, state, turn, n, first = conv, "", 0, 0, False
                allowed = (role or "") in template.after.get(state, ())
                for kind, s, loss in codec.segments(role or "", text or ""):
                    out.append((conv, n, turn, kind, s, loss, allowed))
                    n += 1
                state, turn = role or "", turn + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["conv_id", "segment", "turn_index", "kind", "text", "loss", "allowed"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition(width(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, segment long, turn_index long, kind string, text string, loss boolean, allowed boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted strings say, conversation by conversation: digests of all turns and of the text under the loss.

    Turns are parsed from the strings alone; of the other columns only the loss flags are read. ``segments`` must be
    in the order of format_chat().
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, first, s = Codec(template), None, True, {}
        done: list[tuple] = []

        def close() -> None:
            if s["buffer"]:
                raise ValueError(f"conversation {now}: the formatted text can't be read back")
            done.append((now, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["valid"]))

        for b in batches:
            for conv, text, loss, allowed in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if first or conv != now:
                    if not first:
                        close()
                    now, first = conv, False
                    s = {"buffer": "", "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "valid": True}
                s["chars"] += len(text)
                s["valid"] &= allowed
                if loss:
                    plain = codec.unescape(text)
                    s["loss_chars"] += len(plain)
                    s["loss"].update(plain.encode())
                turns, s["buffer"] = codec.read(s["buffer"] + text)
                for role, plain in turns:
                    s["n"] += 1
                    s["turns"].update(f"{role}\n{plain}\n".encode())
            if done:
                yield batch(done)
                done.clear()
        if not first:
            close()
            yield batch(done)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid_order"])

    return segments.select("conv_id", "text", "loss", "allowed").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid_order boolean")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(rows.unionByName(extra)))
