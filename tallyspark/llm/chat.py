"""Chat formatting by a finite-state machine over roles and a declarative template.

A template gives each role a header, the end of a turn, whether its text is trained on, and which role may follow
which. Control strings inside texts are escaped with a backslash, so the formatted text reads back to the same turns.
Every turn becomes segments (text, loss flag); the machine flags turns that are out of order and conversations that
end in a state where none may end. Turns are sorted into their conversation by one shuffle and then streamed: a
conversation of any length passes through a task row by row.

Null text: empty. Null or unknown roles have a header of their own that holds the name, train nothing, and are out of
order. Turns with the same number follow by role and text, repeated rows are repeated turns. Null conv_id: one
conversation. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "})
    other: str = "### Role "  # then the name's UTF-8 bytes in hex, and ": "
    end: str = " </turn>\n"
    trained: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = ("###", "</turn>")

    @property
    def special(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ("\\", *self.controls))))

    def escape(self, text: str) -> str:
        return self.special.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(" + self.special.pattern + ")", lambda m: m[1], text)

    def header(self, role: str) -> str:
        return self.headers.get(role) or f"{self.other}{role.encode().hex()}: "

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        heads = {h: r for r, h in self.headers.items()}
        head = re.compile("|".join(map(re.escape, heads)) + "|" + re.escape(self.other) + "([0-9a-f]*): ")
        stop = re.compile(r"\\(?:" + self.special.pattern + ")|(" + re.escape(self.end) + ")", re.S)
        at = 0
        while at < len(formatted):
            h = head.match(formatted, at)
            if not h:
                raise ValueError(f"no turn begins at {at}")
            m = stop.search(formatted, h.end())
            while m and not m[1]:
                m = stop.search(formatted, m.end())
            if not m:
                raise ValueError("a turn has no end")
            yield heads[h[0]] if h[0] in heads else bytes.fromhex(h[1]).decode(), self.unescape(formatted[h.end() : m.start()])
            at = m.end()


DEFAULT = Template()
_TURN = "conv_id {kind}, number long, role string, segments array<struct<text:string,loss:boolean>>, in_order boolean"


def format_turns(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, number, role, segments, in_order): one row per turn, a conversation's rows together and in order."""
    rows = turns.select("conv_id", F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, state = object(), 0, ""
        for batch in batches:
            numbers, segments, ordered = [], [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != current:
                    current, number, state = conv, 0, ""
                numbers.append(number)
                ordered.append(role in template.follows.get(state, ()))
                segments.append([{"text": template.header(role), "loss": False}, {"text": template.escape(text), "loss": role in template.trained}, {"text": template.end, "loss": False}])
                number, state = number + 1, role
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), batch.column(2), pa.array(segments, kind), pa.array(ordered, pa.bool_())], ["conv_id", "number", "role", "segments", "in_order"]
            )

    return rows.mapInArrow(run, _TURN.format(kind=rows.schema["conv_id"].dataType.simpleString()))


def conversation_digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation with what is read back from its segments; ``formatted`` as ``format_turns`` gives it."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_ = None, None
        done: list[tuple] = []

        def close() -> None:
            done.append((current, open_["n"], open_["turns"].hexdigest(), open_["loss_chars"], open_["loss"].hexdigest(), open_["chars"], open_["valid"] and open_["role"] in template.final))

        for batch in batches:
            for conv, segments, ordered in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if open_ is None or conv != current:
                    if open_ is not None:
                        close()
                    current, open_ = conv, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "role": ""}
                whole = "".join(s["text"] for s in segments)
                for role, text in template.read(whole):
                    open_["turns"].update(f"{role}\n{text}\n".encode())
                    open_["n"] += 1
                    open_["role"] = role
                trained = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                open_["loss"].update(trained.encode())
                open_["loss_chars"] += len(trained)
                open_["chars"] += len(whole)
                open_["valid"] &= ordered
            yield _rows(done, names, batch.schema.field(0).type)
            done.clear()
        if open_ is not None:
            close()
            yield _rows(done, names, batch.schema.field(0).type)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _rows(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
