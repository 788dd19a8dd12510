"""String and time helpers shared by the parsers (pure column expressions)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Characters Python's str.strip() removes, built from the rule ``c.isspace()``
# (the highest whitespace code point is U+3000).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: trim every Unicode whitespace char at both ends."""
    return F.btrim(col, F.lit(PY_WHITESPACE))


# fixed values: English month abbreviations (the syslog month field)
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def syslog_month(ts_text: Column) -> Column:
    """The month number of a syslog time (NULL: unknown)."""
    month = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MONTHS, start=1))):
        month = F.when(F.substring(ts_text, 1, 3) == name, F.lit(i)).otherwise(month)
    return month


def syslog_time(ts_text: Column, year: int | Column, zoned: bool = True) -> Column:
    """Year-less syslog time ('Jun  9 03:01:42') -> TIMESTAMP in ``year`` (a
    TIMESTAMP_NTZ, the log's own wall clock, unless ``zoned``).

    ``ts_text`` is the envelope's time field (three word characters,
    whitespace, day digits, one whitespace character, eight clock
    characters), so the parts are cut by position and assembled with
    ``try_make_timestamp``: no date-pattern parsing per row.  An unknown month,
    a clock that is not ``dd:dd:dd`` or an impossible date (Feb 29 in a
    common year) yields NULL instead of failing the job.
    """
    n = F.length(ts_text)
    day = py_strip(F.substring(ts_text, F.lit(4), n - 12)).try_cast("int")
    clock = F.substring(ts_text, -8, 8)
    part = lambda pos: F.substring(clock, pos, 2).try_cast("int")
    well_formed = (F.substring(clock, 3, 1) == ":") & (F.substring(clock, 6, 1) == ":")
    make = F.try_make_timestamp if zoned else F.try_make_timestamp_ntz
    return F.when(well_formed, make(year if isinstance(year, Column) else F.lit(year), syslog_month(ts_text), day,
                                    part(1), part(4), part(7).cast("decimal(8,6)")))
