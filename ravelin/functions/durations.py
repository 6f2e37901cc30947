"""Duration text such as ``60s``, ``1h30m`` or ``1.5h`` to microseconds."""

from __future__ import annotations

import re
from decimal import Decimal

# Nanoseconds per unit.
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}

_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def duration_nanos(text: str | int) -> int:
    """A bare integer counts nanoseconds, as does ``"0"``."""
    body = str(text).strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    if body.isdigit():
        return sign * int(body)
    if not body or not re.fullmatch(f"(?:{_PART.pattern})+", body):
        raise ValueError(f"invalid duration {text!r}")
    return sign * int(sum(Decimal(number) * UNIT_NANOS[unit] for number, unit in _PART.findall(body)))


def duration_micros(text: str | int) -> int:
    return duration_nanos(text) // 1000
