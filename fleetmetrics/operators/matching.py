"""Vector matching: arithmetic and set operators between two vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import series_key
from .selectors import compare, divide

_ARITH = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": divide,
}


def pivot_metrics(vector: DataFrame, metrics: Sequence[str], keys: Sequence[str], value: str = "value", require_all: bool = True) -> DataFrame:
    """One-to-one match on ``keys``: the metrics side by side, in one pass and without a join.

    ``keys`` identify an element apart from the metric name (series labels and instant). Where several
    elements of a metric share a key the match is not one-to-one, and the job fails.
    """

    def only(m: str) -> Column:
        own = F.when(F.col("metric") == m, F.col(value))
        return F.when(F.count(own) > 1, F.raise_error(F.lit(f"several elements of {m} share a matching key"))).otherwise(F.max(own))

    agg = [only(m).alias(m) for m in metrics]
    out = vector.where(F.col("metric").isin(list(metrics))).groupBy(*keys).agg(*agg)
    if require_all:
        for m in metrics:
            out = out.where(F.col(m).isNotNull())
    return out


def binary(left: DataFrame, right: DataFrame, op: str, on: Sequence[str], value: str = "value") -> DataFrame:
    """``left op right`` on equal ``on`` columns; comparisons keep the left value and drop the rest.

    The right side has to be unique per ``on`` (one-to-one, or many-to-one with ``group_left``).
    AQE picks the physical join; the right side is broadcast only when its measured size allows.
    """
    joined = left.join(right.select(*on, F.col(value).alias("_rhs")), list(on), "inner")
    if op in _ARITH:
        return joined.withColumn(value, _ARITH[op](F.col(value), F.col("_rhs"))).drop("_rhs")
    return joined.where(compare(F.col(value), op, F.col("_rhs"))).drop("_rhs")


def match_key(df: DataFrame, ignoring: Sequence[str]) -> Column:
    """Matching key of a labelled vector with some labels left out."""
    return series_key(F.col("labels"), ignoring)


def binary_ignoring(left: DataFrame, right: DataFrame, op: str, ignoring: Sequence[str], on_instant: str = "t") -> DataFrame:
    """``left op ignoring(...) right`` for vectors with a label map."""
    lhs = left.withColumn("_m", match_key(left, ignoring))
    rhs = right.select(match_key(right, ignoring).alias("_m"), on_instant, "value")
    return binary(lhs, rhs, op, ["_m", on_instant]).drop("_m")


def keep_matching(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``left and on(...) right``: rows of the left side that have a partner, values unchanged."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def unless(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def keep_if_primary(left: DataFrame, role: DataFrame, on: Sequence[str], primary: float = 2.0, compat_add: bool = False) -> DataFrame:
    """Keep elements of hosts whose role equals ``primary``.

    ``compat_add`` reproduces dashboards that filter by adding the role vector, which also adds
    the role code to the value.
    """
    primaries = role.where(F.col("value") == primary)
    if compat_add:
        return binary(left, primaries, "+", on)
    return keep_matching(left, primaries, on)


def default_zero(df: DataFrame, agg: Column, name: str = "value", default: float = 0.0) -> DataFrame:
    """``agg(...) or on() vector(0)``: a global aggregate that is never empty."""
    return df.agg(F.coalesce(agg.cast("double"), F.lit(float(default))).alias(name))


def absent(expected: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """One element with value 1 for every expected target (and instant) that was not observed."""
    return expected.join(observed.select(*on).distinct(), list(on), "left_anti").withColumn("value", F.lit(1.0))


def zero_fill(dim: DataFrame, categories: Sequence[str], category: str, counts: DataFrame, on: Sequence[str], count: str = "count") -> DataFrame:
    """All combinations of a dimension and a fixed category list, with 0 where nothing was counted.

    The category list is exploded inside each dimension row, so there is no cross join.
    """
    full = dim.withColumn(category, F.explode(F.array(*[F.lit(c) for c in categories])))
    joined = full.join(counts.select(*on, category, count), [*on, category], "left")
    return joined.withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def default_vector(vector: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """``vector or other``: all of the left side plus right elements without a partner."""
    return vector.unionByName(unless(other, vector, on).select(*vector.columns))
