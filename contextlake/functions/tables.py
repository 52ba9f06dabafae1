"""Tables of report rows as text, on the driver: reports have a row for each rule, reason or extension, never for each file."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from contextlake.functions.sizes import UNITS


def short_bytes(size: float) -> str:
    """One decimal below 100 of a unit, none from there on: 1.5 KB, 540 KB."""
    value, unit = float(size or 0), 0
    if value < 1024:
        return f"{size or 0} B"
    while value >= 1024 and unit < len(UNITS) - 2:
        value, unit = value / 1024, unit + 1
    value = math.floor(value + 0.5) if value >= 100 else math.floor(value * 10 + 0.5) / 10
    return f"{value:g} {UNITS[unit]}"


def short_tokens(tokens: int) -> str:
    return f"~{tokens or 0} tokens" if (tokens or 0) < 1000 else f"~{math.floor(tokens / 1000 + 0.5)}k tokens"


Columns = Sequence[tuple[str, str, bool]]


def _cell(row: Mapping, key: str) -> str:
    return "" if row[key] is None else str(row[key])


def text_table(columns: Columns, rows: Sequence[Mapping], indent: str = "") -> list[str]:
    """Lines of a table of fixed widths, heading first. columns: (key, label, whether it stands on the right)."""
    widths = [max([len(label), *(len(_cell(r, key)) for r in rows)]) for key, label, _ in columns]
    line = lambda cells: indent + "  ".join(c.rjust(w) if right else c.ljust(w) for c, w, (_, _, right) in zip(cells, widths, columns, strict=True)).rstrip()
    return [line([label for _, label, _ in columns]), *(line([_cell(r, key) for key, _, _ in columns]) for r in rows)]


def markdown_table(columns: Columns, rows: Sequence[Mapping]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    rule = "|" + "|".join("---:" if right else "---" for _, _, right in columns) + "|"
    return [line([label for _, label, _ in columns]), rule, *(line([_cell(r, key) for key, _, _ in columns]) for r in rows)]
