"""Durations of rules and correlations, in microseconds."""

from __future__ import annotations

import re

UNITS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
_GO_UNITS = {"ns": 1e-3, "us": 1, "µs": 1, "μs": 1, "ms": 1e3, "s": 1e6, "m": 6e7, "h": 3.6e9}
_LIMIT = (1 << 63) // 1000


def parse_timespan(text: str) -> int:
    """`<positive int><s|m|h|d>`; ValueError otherwise."""
    m = re.fullmatch(r"([0-9]+)([smhd])", str(text).strip())
    if not m or int(m[1]) <= 0:
        raise ValueError(f"not a timespan: {text!r}")
    value = int(m[1]) * UNITS[m[2]]
    if value >= _LIMIT:
        raise ValueError(f"timespan too long: {text!r}")
    return value


def parse_timeframe(text: str) -> int:
    """A timespan, else a compound duration such as 1h30m or -5m, else whole nanoseconds."""
    try:
        return parse_timespan(text)
    except ValueError:
        pass
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|μs|ms|s|m|h)", body)
    if parts and "".join(a + b for a, b in parts) == body:
        return int(sign * sum(float(a) * _GO_UNITS[b] for a, b in parts))
    if re.fullmatch(r"[0-9]+", body):
        return sign * int(body) // 1000
    raise ValueError(f"not a duration: {text!r}")


def format_timespan(micros: int) -> str:
    """The largest unit that divides it."""
    for unit in "dhms":
        if micros % UNITS[unit] == 0 and micros:
            return f"{micros // UNITS[unit]}{unit}"
    raise ValueError(f"no whole seconds: {micros}")
