"""Logging and timing for user transforms."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

_log = logging.getLogger("strandlog.user")

_LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}


def log(value: object, level: str = "info") -> None:
    """Writes a value to the log of user code; unknown levels count as info."""
    _log.log(_LEVELS.get(level.lower(), logging.INFO), "%s", value)


class Timings:
    """Named stretches of time: the first call of a name begins it, a call with ``end`` closes it."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self._clock, self._open = clock, {}
        self.seconds: dict[str, list[float]] = {}

    def timing(self, name: str, end: bool = False) -> None:
        if not end:
            self._open[name] = self._clock()
        elif name in self._open:
            self.seconds.setdefault(name, []).append(self._clock() - self._open.pop(name))
