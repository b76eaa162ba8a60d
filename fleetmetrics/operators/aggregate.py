"""Aggregation by, without and over everything; top-N, latest state, value mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import label, series_key
from .selectors import largest

# NaN is the largest double in an order, but the smallest number is already never NaN beside others
_FN = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": lambda v: largest(F.col(v)), "count": F.count}


def _aggs(fns: Sequence[str], value: str) -> list[Column]:
    return [_FN[f](value).alias(f) for f in fns]


def agg_by(vector: DataFrame, by: Sequence[str], fns: Sequence[str], value: str = "value", extra: Sequence[str] = ()) -> DataFrame:
    """``fn by (labels)``; an unknown label groups as ''. ``extra`` are plain columns such as the instant."""
    named = [c if c in vector.columns else label(vector, c).alias(c) for c in by]
    return vector.groupBy(*named, *extra).agg(*_aggs(fns, value))


def agg_without(vector: DataFrame, without: Sequence[str], fns: Sequence[str], value: str = "value", extra: Sequence[str] = ()) -> DataFrame:
    """``fn without (labels)`` on a label map: the remaining labels form the group."""
    return vector.withColumn("series_key", series_key(F.col("labels"), without)).groupBy("series_key", *extra).agg(*_aggs(fns, value))


def agg_all(vector: DataFrame, fns: Sequence[str], value: str = "value") -> DataFrame:
    return vector.agg(*_aggs(fns, value))


def count_groups(vector: DataFrame, by: Sequence[str], name: str = "groups") -> DataFrame:
    """``count(count by (x) (v))``; the distinct keys are combined on the map side."""
    return vector.select(*[label(vector, c).alias(c) for c in by]).distinct().agg(F.count("*").alias(name))


def top_n(df: DataFrame, order: str, n: int, ties: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The n largest rows, overall or within groups, with a total order.

    Overall this is a bounded heap per task; within groups the rank filter lets Spark cut every
    group to n rows before the shuffle.
    """
    # NaN counts as smaller than any number
    number = isinstance(df.schema[order].dataType, (T.DoubleType, T.FloatType))
    by = [*([F.isnan(order).asc()] if number else []), F.col(order).desc(), *[F.col(c).asc() for c in ties]]
    if not within:
        return df.orderBy(*by).limit(n)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest row of each group; ties are settled by the other columns.

    A rank of one lets Spark cut every group to one row in each task, before the shuffle.
    """
    newest = [F.col(c).desc() for c in (*order, *[c for c in columns if c not in order])]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*newest))
    picked = [*by, *[c for c in columns if c not in by]]
    return df.select(*dict.fromkeys([*by, *order, *columns])).withColumn("_rank", rank).where("_rank = 1").select(*picked)


def label_values(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of a label, in order."""
    return df.select(label(df, name).alias(name)).where(F.col(name) != "").distinct().orderBy(name)


def reduce_series(vector: DataFrame, how: str, keys: Sequence[str], value: str = "value", ts: str = "t") -> DataFrame:
    """Panel reduction of a range result to one value per series: ``mean`` or ``lastNotNull``."""
    present = vector.where(F.col(value).isNotNull())
    agg = F.avg(value) if how == "mean" else F.max_by(value, F.unix_micros(ts))
    return present.groupBy(*keys).agg(agg.alias(value))


def map_values(v: Column, exact: Mapping[float, str] | None = None, ranges: Sequence[tuple[float, float, str]] = (), null_text: str | None = None) -> Column:
    """Value and range mappings to text (both range ends inclusive)."""
    out = F.when(v.isNull(), F.lit(null_text))
    for number, text in (exact or {}).items():
        out = out.when(v == number, F.lit(text))
    for low, high, text in ranges:
        out = out.when(v.between(low, high), F.lit(text))
    return out.otherwise(v.cast("string"))


def band(v: Column, steps: Sequence[tuple[float | None, str]], low: Column | None = None, high: Column | None = None) -> Column:
    """Threshold band: the last step whose bound is reached; percentage steps when low/high are given."""
    x = v if low is None else 100 * (v - low) / (high - low)
    out = F.lit(steps[0][1])
    for bound, text in steps[1:]:
        out = F.when(x >= bound, F.lit(text)).otherwise(out)
    return out


def merge_frames(frames: Sequence[DataFrame], on: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Panel ``merge`` + ``organize``: join on the shared columns, then pick, order and rename."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(on), "full_outer")
    return out.select(*[F.col(c).alias(n) for c, n in columns.items()])
