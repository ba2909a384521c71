"""Time functions on timestamps without zone, to the microsecond."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = "2000-01-01 00:00:00"
_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def interval_micros(text: str) -> int:
    """Microseconds of an interval such as ``'1 day 6 hours'``; months and years have no fixed width."""
    found = re.findall(r"(-?\d+)\s*([a-z]+)", text.lower())
    if not found or re.sub(r"(-?\d+)\s*([a-z]+)", "", text.lower()).strip():
        raise ValueError(f"not an interval: {text!r}")
    total = 0
    for n, unit in found:
        unit = unit.rstrip("s")
        if unit in ("month", "year", "decade", "quarter"):
            raise ValueError(f"{text!r}: intervals of months have no fixed width")
        if unit not in _UNITS:
            raise ValueError(f"{text!r}: unknown unit {unit!r}")
        total += int(n) * _UNITS[unit]
    return total


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _since_origin(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), ts)


def _after_origin(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit(ORIGIN).cast("timestamp_ntz"))


def time_bucket(width: str, ts: Column | str, offset: str | None = None) -> Column:
    """Start of the ``width`` wide bucket that holds ``ts``; buckets count from 2000-01-01 plus ``offset``."""
    w = interval_micros(width)
    if w <= 0:
        raise ValueError("the bucket width must be positive")
    off = interval_micros(offset) if offset else 0
    d = _since_origin(_col(ts)) - F.lit(off)
    return _after_origin(d - F.pmod(d, F.lit(w).cast("long")) + F.lit(off))


def date_trunc(unit: str, ts: Column | str) -> Column:
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(ts))


def epoch(ts: Column | str) -> Column:
    """Seconds since 1970, with their fraction."""
    return micros(ts) / F.lit(1_000_000.0)


def extract(field: str, ts: Column | str) -> Column:
    """A field of a time as a bigint; dow is 0 on Sundays; epoch in whole seconds."""
    c, field = _col(ts), field.lower()
    if field == "epoch":
        return F.floor(micros(c) / 1_000_000).cast("long")
    if field in ("millisecond", "milliseconds"):
        return (F.second(c) * 1000 + F.floor(F.pmod(micros(c), F.lit(1_000_000)) / 1000)).cast("long")
    if field in ("microsecond", "microseconds"):
        return (F.second(c) * 1_000_000 + F.pmod(micros(c), F.lit(1_000_000))).cast("long")
    if field == "dow":
        return (F.dayofweek(c) - 1).cast("long")
    plain = {"minute": F.minute, "hour": F.hour, "second": F.second, "day": F.dayofmonth, "month": F.month, "year": F.year, "quarter": F.quarter, "week": F.weekofyear, "doy": F.dayofyear}
    if field not in plain:
        raise ValueError(f"unknown field {field!r}")
    return plain[field](c).cast("long")


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_add("SECOND", _col(seconds), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def micros_to_timestamp(n: Column | str) -> Column:
    """1970 plus so many microseconds."""
    return F.timestamp_add("MICROSECOND", _col(n), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def age_at_least(birthday: Column | str, years: int, now: str) -> Column:
    """Whether ``years`` full years have passed at ``now`` (given, so that results do not depend on the clock)."""
    return F.add_months(_col(birthday).cast("date"), 12 * years) <= F.lit(now).cast("date")
