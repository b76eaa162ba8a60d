"""Durations and instants as microseconds, and exact integer division on columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 604800 * 10**6}


def micros(duration: str | int | float | dt.timedelta) -> int:
    """``"1d"``, ``"1h30m"``, seconds or a timedelta as microseconds."""
    if isinstance(duration, dt.timedelta):
        return round(duration.total_seconds() * 10**6)
    if isinstance(duration, (int, float)):
        return round(duration * 10**6)
    parts = re.findall(r"(\d+)\s*(us|ms|s|m|h|d|w)", duration)
    if not parts or re.sub(r"(\d+)\s*(us|ms|s|m|h|d|w)|\s", "", duration):
        raise ValueError(f"not a duration: {duration!r}")
    return sum(int(n) * _UNIT[u] for n, u in parts)


def instant_micros(when: str | int | dt.datetime) -> int:
    """A UTC instant as microseconds; integers are taken as microseconds already."""
    if isinstance(when, int):
        return when
    if isinstance(when, str):
        when = dt.datetime.fromisoformat(when)
    if when.tzinfo is None:
        when = when.replace(tzinfo=dt.timezone.utc)
    return round((when - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def ceil_div(x: Column, n: int) -> Column:
    """Exact integer ceil(x / n), also below zero; no detour through doubles."""
    return _div(x + F.pmod(-x, F.lit(n)), n)


def floor_div(x: Column, n: int) -> Column:
    """Exact integer floor(x / n), also below zero."""
    return _div(x - F.pmod(x, F.lit(n)), n)


def _div(x: Column, n: int) -> Column:
    # the dividend is a multiple of n here, so the quotient is integral
    return F.call_function("div", x, F.lit(n).cast("bigint"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps in seconds with the fraction kept."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)
