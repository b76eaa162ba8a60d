"""Label selectors, value filters and element-wise arithmetic."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import label
from ..timeutil import seconds_between

_LITERAL = re.compile(r"[A-Za-z0-9_\-/ ]+")


def anchored(pattern: str) -> str:
    """Selector expressions match the whole label value."""
    return f"^(?:{pattern})$"


def matcher(df: DataFrame, name: str, op: str, value: str) -> Column:
    """One label matcher; ``op`` is ``=``, ``!=``, ``=~`` or ``!~``.

    Positive matchers on promoted columns are left as plain comparisons, and alternations of plain
    words become IN lists, so that both are pushed into the scan.
    """
    promoted = name in df.columns
    words = value.split("|")
    plain = all(_LITERAL.fullmatch(w) for w in words)
    if op == "=":
        return (F.col(name) == value) if promoted and value else label(df, name) == value
    if op == "!=":
        return label(df, name) != value
    if op == "=~":
        if plain:
            return F.col(name).isin(words) if promoted else label(df, name).isin(words)
        return label(df, name).rlike(anchored(value))
    if op == "!~":
        return ~label(df, name).isin(words) if plain else ~label(df, name).rlike(anchored(value))
    raise ValueError(f"unknown matcher {op!r}")


def select(df: DataFrame, metric: str | Iterable[str] | None = None, matchers: Iterable[tuple[str, str, str]] = (), **equal: str) -> DataFrame:
    """Vector selector: metric name(s) plus ``(label, op, value)`` matchers and ``label=value`` pairs."""
    if metric is not None:
        names = [metric] if isinstance(metric, str) else list(metric)
        df = df.where(F.col("metric") == names[0]) if len(names) == 1 else df.where(F.col("metric").isin(names))
    for name, value in equal.items():
        df = df.where(matcher(df, name, "=", value))
    for name, op, value in matchers:
        df = df.where(matcher(df, name, op, value))
    return df


_COMPARE = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def compare(left: Column, op: str, right: Column | float) -> Column:
    """Comparison of numbers; with NaN on either side only ``!=`` holds."""
    right = right if isinstance(right, Column) else F.lit(right)
    odd, holds = F.isnan(left) | F.isnan(right), _COMPARE[op](left, right)
    return (holds | odd) if op == "!=" else (holds & ~odd)


def divide(a: Column, b: Column) -> Column:
    """Floating-point division: x/0 is infinite, 0/0 is NaN; NULL stays NULL."""
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b != 0, a / b).when(b == 0, by_zero)


def largest(v: Column) -> Column:
    """Aggregate: the largest number; NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v))


def filter_value(df: DataFrame, op: str, threshold: Column | float, value: str = "value") -> DataFrame:
    """Comparison filter: failing elements are dropped, the others keep their value."""
    return df.where(compare(F.col(value), op, threshold))


def clamp_min(v: Column, low: float) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(float(low))))


def clamp_max(v: Column, high: float) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.least(v, F.lit(float(high))))


def age_seconds(now: Column, then: Column) -> Column:
    """``time() - v`` for timestamps."""
    return seconds_between(now, then)


def non_negative(v: Column) -> Column:
    """NULL and negative values read as zero."""
    return F.greatest(F.coalesce(v, F.lit(0)), F.lit(0))


def encode(v: Column, codes: Mapping[object, float], default: object = None) -> Column:
    """Status text or flag to number, by equality."""
    out = None
    for key, code in codes.items():
        out = F.when(v == key, F.lit(code)) if out is None else out.when(v == key, F.lit(code))
    return out if default is None else out.otherwise(F.lit(default))


# fixed values: "no limit" as reported by the two control-group versions
UNLIMITED = {"legacy": 9223372036854771712, "unified": 9223372036854775807}


def unlimited_to_zero(mode: Column, v: Column) -> Column:
    hit = F.lit(False)
    for name, sentinel in UNLIMITED.items():
        hit = hit | ((mode == name) & (v == F.lit(sentinel)))
    return F.when(hit, F.lit(0)).otherwise(v)


def overdue(last: Column, interval: Column, as_of: Column) -> Column:
    """Never run, or last run strictly longer ago than the interval."""
    return last.isNull() | (last < as_of - interval)
