"""Relative search times: ``now``, offsets and snaps such as ``-7d@d``, ``@w1``, ``-1mon@mon+8h``.

An expression is a chain of steps from ``now``: an offset ``[+-]N<unit>`` adds that many units,
a snap ``@<unit>`` goes down to the unit's start; ``@w0`` .. ``@w6`` is the latest Sunday ..
Saturday (``@w`` and ``@w7``: Sunday).  Everything is folded on the driver into one instant, so a
search's bounds are literals that reach the scan.
"""
from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

# fixed values: unit names of search expressions
UNITS = {
    "s": "second", "sec": "second", "secs": "second", "second": "second", "seconds": "second",
    "m": "minute", "min": "minute", "mins": "minute", "minute": "minute", "minutes": "minute",
    "h": "hour", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour",
    "d": "day", "day": "day", "days": "day",
    "w": "week", "week": "week", "weeks": "week",
    "mon": "month", "month": "month", "months": "month",
    "q": "quarter", "qtr": "quarter", "qtrs": "quarter", "quarter": "quarter", "quarters": "quarter",
    "y": "year", "yr": "year", "yrs": "year", "year": "year", "years": "year",
}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
_STEP = re.compile(r"(?P<sign>[+-])(?P<n>[0-9]*)(?P<unit>[a-z]+)|@(?P<snap>w[0-7]|[a-z]+)")


def _unit(name: str, expression: str) -> str:
    if name not in UNITS:
        raise ValueError(f"unknown unit {name!r} in {expression!r}")
    return UNITS[name]


def _moved(t: datetime, n: int, unit: str) -> datetime:
    if unit not in _MONTHS:
        return t + timedelta(**{f"{unit}s": n})
    month = t.year * 12 + t.month - 1 + n * _MONTHS[unit]
    year, month = divmod(month, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


def _start(t: datetime, unit: str, weekday: int = 0) -> datetime:
    """The start of the unit that ``t`` lies in; weeks begin on ``weekday`` (0: Sunday)."""
    t = t.replace(microsecond=0)
    if unit == "second":
        return t
    t = t.replace(second=0)
    if unit == "minute":
        return t
    t = t.replace(minute=0)
    if unit == "hour":
        return t
    t = t.replace(hour=0)
    if unit == "week":
        return t - timedelta(days=(t.isoweekday() - weekday) % 7)
    if unit == "month":
        return t.replace(day=1)
    if unit == "quarter":
        return t.replace(month=(t.month - 1) // 3 * 3 + 1, day=1)
    return t.replace(month=1, day=1) if unit == "year" else t


def resolve(expression: str, now: datetime) -> datetime:
    """The instant that ``expression`` names; ISO times stand for themselves."""
    text = expression.strip().lower()
    rest = text.removeprefix("now")
    if rest == text and not text[:1] in ("+", "-", "@"):
        return datetime.fromisoformat(expression.strip())
    t, at = now, 0
    while at < len(rest):
        step = _STEP.match(rest, at)
        if not step:
            raise ValueError(f"cannot read {rest[at:]!r} in {expression!r}")
        if step["snap"]:
            day = re.fullmatch("w([0-7])", step["snap"])
            t = _start(t, "week", int(day[1]) % 7) if day else _start(t, _unit(step["snap"], expression))
        else:
            t = _moved(t, int(step["sign"] + (step["n"] or "1")), _unit(step["unit"], expression))
        at = step.end()
    return t
