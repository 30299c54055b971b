"""Durations as job configurations write them."""

from __future__ import annotations

import re

# The units of durations in seconds.
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}

_DURATION = re.compile(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)")


def seconds(duration: str | float) -> float:
    """A duration as text (``1h30m``, ``1.5s``, ``200ms``) or as a number of seconds."""
    if not isinstance(duration, str):
        return float(duration)
    text = duration.strip()
    parts = _DURATION.findall(text)
    if text == "0":
        return 0.0
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"no duration: {duration!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)
