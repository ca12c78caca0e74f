"""Range arguments such as '101', '101-200', '101-' and '-5'."""

from __future__ import annotations

import re

from pyspark.sql import Column


def parse_range(text: str, single: str = "exact") -> tuple[int, int | None]:
    """First and last number; no last one: open. ``single``: what a lone number N means, 'exact' (N to N) or 'upto' (1 to N)."""
    m = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", text)
    if not m or not (m[1] or m[3]):
        raise ValueError(f"no range: {text!r}")
    if not m[2]:
        n = int(m[1] or m[3])
        return (1, n) if single == "upto" else (n, n)
    return int(m[1] or 1), int(m[3]) if m[3] else None


def in_range(number: Column, bounds: tuple[int, int | None]) -> Column:
    low, high = bounds
    return number >= low if high is None else number.between(low, high)


def range_label(bounds: tuple[int, int | None]) -> str:
    return f"{bounds[0]}+" if bounds[1] is None else f"{bounds[0]}-{bounds[1]}"


def retry_delays(attempts: int, step: float = 10.0, most: float = 600.0) -> list[float]:
    """A bounded ladder of growing delays."""
    return [min(step * (i + 1), most) for i in range(attempts)]

