"""Chat formatting: a role machine checks the turns, a template writes them, a mask marks the loss.

The template is data: what opens and closes a turn, and which roles' texts count for the loss. Turn
texts and roles may contain the template's control strings, which all start with ``<|``; every
``<``, ``%``..., ``|`` inside gets one more ``%`` after the ``<``. That leaves no ``<|`` in a text and
can be taken back exactly.

Turns are dealt by conversation and sorted, and each task streams over its rows with the state of
one conversation in hand: a conversation of any length needs no more memory than an Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"<(%*)\|")
_UNESCAPE = re.compile(r"<%(%*)\|")

#: role machine: state -> {role: next state}; a conversation is valid if it ends in a final state of its template
TURN_ORDER = {
    "start": {"system": "primed", "user": "asked"},
    "primed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
FINAL = ("answered",)


@dataclass(frozen=True)
class Template:
    """{role} stands for the turn's role; the text goes between open and close."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict = field(default_factory=lambda: TURN_ORDER)
    final: tuple[str, ...] = FINAL


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<%\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<%" in text else text


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(formatted text, counts for the loss) of one turn, in order."""
    opened = template.open.replace("{role}", escape(role).replace("\n", "<%n|"))
    return [(opened, False), (escape(text), role in template.loss_roles), (template.close, False)]


def read_turn(formatted: str, template: Template) -> tuple[str, str]:
    """Role and text back from one turn's formatted string."""
    before, after = template.open.split("{role}")
    if not (formatted.startswith(before) and formatted.endswith(template.close)):
        raise ValueError("not a turn of this template")
    role, _, text = formatted[len(before) : len(formatted) - len(template.close)].partition(after)
    return unescape(role.replace("<%n|", "\n")), unescape(text)


def _ordered(turns: DataFrame) -> DataFrame:
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turn, position, segments (text, loss) and valid_so_far, one row per turn, in order within a conversation.

    Null roles and texts are empty. Turns with equal numbers go by role, then text; repeated rows stay.
    Null conv_id or turn is a value of its own, sorted first. Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position, started = None, "start", 0, False
        for batch in batches:
            convs, numbers, marked, places, valid = [], [], [], [], []
            for c, n, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not started or c != conv:
                    conv, state, position, started = c, "start", 0, True
                state = template.order.get(state, {}).get(role, "invalid")
                convs.append(c)
                numbers.append(n)
                places.append(position)
                marked.append([{"text": t, "loss": x} for t, x in segments(role, text, template)])
                valid.append(state != "invalid")
                position += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64()), pa.array(marked, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), pa.array(valid, pa.bool_())],
                names=["conv_id", "turn", "position", "segments", "valid_so_far"],
            )

    schema = "conv_id long, turn long, position long, segments array<struct<text:string,loss:boolean>>, valid_so_far boolean"
    return _ordered(turns).mapInArrow(run, schema)


def digest_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its formatted segments, not from its turns.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline of every turn), loss_chars and
    loss_sha256 (text under the loss mask, unescaped), formatted_chars, valid (the role machine took
    every turn and ended in a final state). Nulls and ties as in format_turns(). No rows: no rows.
    """
    # format_turns() keeps a conversation's rows together and in order, so this runs over the same partitions

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        done: list[tuple] = []

        def close() -> None:
            n, turn_sum, loss, loss_sum, chars, ok, state = held
            done.append((conv, n, turn_sum.hexdigest(), loss, loss_sum.hexdigest(), chars, ok and state in template.final))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*done, strict=True)) or [[]] * 7
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for c, marked, ok in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if held is None or c != conv:
                    if held is not None:
                        close()
                    conv, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, "start"]
                formatted = "".join(s["text"] for s in marked)
                role, text = read_turn(formatted, template)
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode())
                for s in marked:
                    if s["loss"]:
                        plain = unescape(s["text"])
                        held[2] += len(plain)
                        held[3].update(plain.encode())
                held[4] += len(formatted)
                held[5] = held[5] and ok
                held[6] = template.order.get(held[6], {}).get(role, "invalid")
            if done:
                yield out()
                done.clear()
        if held is not None:
            close()
            yield out()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return format_turns(turns, template).mapInArrow(run, schema)
