"""When a cron trigger is due: standard five-field expressions, their short names and ``@every``."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from ..sources.durations import seconds

# The short names of schedules, the names of months and weekdays.
_NAMED = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]

_FAR = 5 * 366  # days in which an expression that is ever due is due


def _values(field: str, low: int, high: int, names: list[str] | None = None, base: int = 0) -> tuple[frozenset[int], bool]:
    """The numbers of one field and whether it is a star."""

    def number(text: str) -> int:
        if names and text.lower() in names:
            return names.index(text.lower()) + base
        if not text.isdigit():
            raise ValueError(f"no number: {text!r}")
        return int(text)

    found: set[int] = set()
    star = False
    for part in field.split(","):
        span, _, step = part.partition("/")
        n = number(step) if step else 1
        if span in ("*", "?"):
            a, z = low, high
            star = star or not step
        else:
            first, dash, last = span.partition("-")
            a = number(first)
            z = number(last) if dash else (high if step else a)
        if n < 1 or not low <= a <= z <= high:
            raise ValueError(f"{field!r} is not within {low}-{high}")
        found.update(range(a, z + 1, n))
    return frozenset(found), star


@dataclass(frozen=True)
class Schedule:
    """``every`` seconds, or the minutes, hours, days, months and weekdays (Sunday is 0) when it is due."""

    every: float | None = None
    minutes: frozenset[int] = frozenset()
    hours: frozenset[int] = frozenset()
    days: frozenset[int] = frozenset()
    months: frozenset[int] = frozenset()
    weekdays: frozenset[int] = frozenset()
    any_day: bool = True

    @classmethod
    def parse(cls, text: str) -> "Schedule":
        spec = text.strip()
        if spec.startswith("@every "):
            every = seconds(spec[7:])
            if every <= 0:
                raise ValueError("a schedule of no duration")
            return cls(max(1.0, every))
        fields = _NAMED.get(spec.lower(), spec).split()
        if len(fields) != 5:
            raise ValueError(f"no schedule: {text!r}")
        minutes, _ = _values(fields[0], 0, 59)
        hours, _ = _values(fields[1], 0, 23)
        days, every_day = _values(fields[2], 1, 31)
        months, _ = _values(fields[3], 1, 12, _MONTHS, 1)
        weekdays, every_weekday = _values(fields[4], 0, 6, _DAYS)
        return cls(None, minutes, hours, days, months, weekdays, every_day or every_weekday)

    def _on(self, day: dt.date) -> bool:
        in_month, in_week = day.day in self.days, day.isoweekday() % 7 in self.weekdays
        # days of the month and of the week are alternatives only if both are given
        return day.month in self.months and (in_month and in_week if self.any_day else in_month or in_week)

    def after(self, moment: float) -> float | None:
        """The first due time after ``moment`` (seconds since 1970, UTC); None if there is none within five years."""
        if self.every is not None:
            return moment + self.every
        start = dt.datetime.fromtimestamp(moment, dt.UTC).replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        for n in range(_FAR):
            day = start.date() + dt.timedelta(days=n)
            if not self._on(day):
                continue
            for hour in sorted(self.hours):
                for minute in sorted(self.minutes):
                    at = dt.datetime(day.year, day.month, day.day, hour, minute, tzinfo=dt.UTC)
                    if at >= start:
                        return at.timestamp()
        return None
