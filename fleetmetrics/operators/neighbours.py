"""Neighbour and running computations along time that never sort a whole series in one task.

A series is cut into chunks of time.  The ordered work runs per (series, chunk); what crosses a
chunk border is carried by a small frame with one row per (series, chunk), whose size follows the
time span and not the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..timeutil import floor_div, micros


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], ties: Sequence[str] = (), chunk="1h", prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<column>``: the value in the preceding row of the same series."""
    size = micros(chunk)
    cut = df.withColumn("_c", floor_div(F.unix_micros(ts), size))
    w = Window.partitionBy("_c", *keys).orderBy(ts, *ties)
    row = F.struct(*columns)
    inner = cut.withColumn("_p", F.lag(row).over(w))
    carried = _chunk_ends(cut, keys, ts, columns, ties, row).select(*keys, "_c", F.lag("_row").over(Window.partitionBy(*keys).orderBy("_c")).alias("_q"))
    joined = _rejoin(inner, carried, [*keys, "_c"]).withColumn("_p", F.coalesce("_p", "_q"))
    return joined.select(*df.columns, *[F.col(f"_p.{c}").alias(f"{prefix}{c}") for c in columns])


def _rejoin(rows: DataFrame, carried: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL, which is a key like any other."""
    other = carried.withColumnsRenamed({c: f"_k_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]
    return rows.join(other, same, "left").drop(*[f"_k_{c}" for c in on])


def _chunk_ends(cut: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], ties: Sequence[str], row: Column) -> DataFrame:
    """The last row of every (series, chunk).  Fixed-width maxima are hash-aggregated; structs need a sort."""
    if list(columns) == [ts]:
        return cut.groupBy(*keys, "_c").agg(F.max(ts).alias(ts)).withColumn("_row", row)
    if not ties:
        return cut.groupBy(*keys, "_c").agg(*[F.max_by(c, ts).alias(c) for c in columns]).withColumn("_row", row)
    return cut.groupBy(*keys, "_c").agg(F.max(F.struct(ts, *ties, row.alias("_row"))).alias("_l")).select(*keys, "_c", F.col("_l._row").alias("_row"))


def running_total(df: DataFrame, keys: Sequence[str], ts: str, value: str, ties: Sequence[str] = (), chunk="1h", restart="1d") -> DataFrame:
    """Replace ``value`` by its running total within each series and ``restart`` interval."""
    size, span = micros(chunk), micros(restart)
    if span % size:
        raise ValueError("the restart interval has to be a multiple of the chunk")
    u = F.unix_micros(ts)
    cut = df.withColumn("_c", floor_div(u, size)).withColumn("_e", floor_div(u, span))
    w = Window.partitionBy("_c", *keys).orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn("_s", F.sum(value).over(w))
    totals = cut.groupBy(*keys, "_e", "_c").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys, "_e").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(*keys, "_c", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_o"))
    joined = _rejoin(inner, offset, [*keys, "_c"])
    return joined.withColumn(value, F.col("_s") + F.col("_o")).select(*df.columns)
