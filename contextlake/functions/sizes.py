"""Sizes and durations for people."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: how far up documents, stages and everything else count
DOCUMENT_UNITS, STAGE_UNITS, ALL_UNITS = UNITS[:4], UNITS[:5], UNITS


def format_bytes(size: Column, units: tuple[str, ...] = DOCUMENT_UNITS, decimals: int = 2) -> Column:
    """1536 is 1.5 KB; so many decimals at most, without trailing zeros."""
    out = F.lit("0 B")
    for k, unit in enumerate(units):
        value = F.round(size / F.lit(float(1024**k)), max(0, decimals)).cast("string")
        out = F.when(size >= 1024**k, F.concat(F.regexp_replace(value, r"\.0$", ""), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_size(text: str) -> int:
    """Bytes of ``10``, ``1.5MB``, ``2 gb``; binary units, rounded down."""
    found = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*(?:([KMGT]?)B)?", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * 1024 ** " KMGT".index((found[2] or " ").upper()))


def format_duration(ms: float) -> str:
    """Whole units from the largest that is not zero: 999ms, 1s, 1m 5s, 2h 0m 3s."""
    if ms < 1000:
        return f"{ms:.0f}ms"
    seconds = int(ms // 1000)
    hours, minutes, seconds = seconds // 3600, seconds // 60 % 60, seconds % 60
    return f"{hours}h {minutes}m {seconds}s" if hours else f"{minutes}m {seconds}s" if minutes else f"{seconds}s"


def format_elapsed(ms: float) -> str:
    """One decimal of the fitting unit: 250ms, 1.5s, 2.0m."""
    return f"{ms:.0f}ms" if ms < 1000 else f"{ms / 1000:.1f}s" if ms < 60_000 else f"{ms / 60_000:.1f}m"
