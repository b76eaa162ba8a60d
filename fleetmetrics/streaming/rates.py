"""Counter rates out of the stream: chained windowed aggregations, without Python.

Samples of one bucket of time are put in order and become one counter state; buckets of a window are
merged in time order, with the step from each bucket to the next. A row leaves when the watermark has
passed the end of its window. The state of a series holds the samples of open buckets and the states of
open windows, so a busy series is cut by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pandas import Timedelta
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import windows as W


def _lost(a: Column, b: Column) -> Column:
    """What a reset between two neighbouring values hides."""
    return F.when(b < a, a).otherwise(F.lit(0.0))


def _total(parts: Column, zero: Column) -> Column:
    return F.aggregate(parts, zero, lambda x, y: x + y)


def _state(points: Column) -> Column:
    """Ordered samples (u, v) of a bucket as one state."""
    n = F.size(points)
    first, last, pen = F.get(points, F.lit(0)), F.get(points, n - 1), F.get(points, n - 2)
    pairs = F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n), lambda a, b: F.when(b.isNotNull(), _lost(a["v"], b["v"])).otherwise(F.lit(0.0)))
    return F.struct(
        first["u"].alias("first_u"), first["v"].alias("first_v"), last["u"].alias("last_u"), last["v"].alias("last_v"),
        F.when(n > 1, pen["u"]).alias("pen_u"), F.when(n > 1, pen["v"]).alias("pen_v"), n.cast("long").alias("n"), _total(pairs, F.lit(0.0)).alias("corr"),
    )


def bucket_states(samples: DataFrame, bucket, keys: Sequence[str] = ("series_key",), delay="10 minutes", value: str = "value", ts: str = "ts") -> DataFrame:
    """(keys, bucket, state) of every bucket ``(t - bucket, t]`` that the watermark has closed."""
    moved = samples.select(*keys, F.unix_micros(ts).alias("u"), F.col(value).cast("double").alias("v"), (F.col(ts) - F.expr("interval 1 microsecond")).alias("_w")).where("v is not null").withWatermark("_w", delay)
    # samples of one instant are one sample: the largest value
    ordered = F.array_sort(F.collect_set(F.struct("u", "v")))
    closed = moved.groupBy(*keys, F.window("_w", bucket).alias("bucket")).agg(ordered.alias("points"))
    points = closed.withColumn("points", F.filter("points", lambda p, i: F.coalesce(F.get(F.col("points"), i + 1)["u"] != p["u"], F.lit(True))))
    return points.select(*keys, "bucket", _state(F.col("points")).alias("state"))


def window_states(samples: DataFrame, size, slide, bucket, keys: Sequence[str] = ("series_key",), delay="10 minutes", value: str = "value", ts: str = "ts") -> DataFrame:
    """Merged counter states of the windows ``(t - size, t]`` at every multiple ``t`` of ``slide``, in the
    columns that ``operators.windows`` computes growth and rates from."""
    if Timedelta(size) % Timedelta(bucket) or Timedelta(slide) % Timedelta(bucket):
        raise ValueError("size and slide have to be multiples of the bucket")
    states = bucket_states(samples, bucket, keys, delay, value, ts)
    merged = states.groupBy(*keys, F.window(F.window_time("bucket"), size, slide).alias("window")).agg(F.array_sort(F.collect_list("state")).alias("s"))
    s = F.col("s")
    n = F.size(s)
    first, last, before = F.get(s, F.lit(0)), F.get(s, n - 1), F.get(s, n - 2)
    steps = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n), lambda a, b: F.when(b.isNotNull(), _lost(a["last_v"], b["first_v"])).otherwise(F.lit(0.0)))
    corr = _total(F.transform(s, lambda x: x["corr"]), F.lit(0.0)) + _total(steps, F.lit(0.0))
    t = F.col("window.end")
    return merged.select(
        *keys, t.alias("t"), F.unix_micros(t).alias("_t"), _total(F.transform(s, lambda x: x["n"]), F.lit(0).cast("long")).alias("n"),
        *[first[c].alias(c) for c in ("first_u", "first_v")], *[last[c].alias(c) for c in ("last_u", "last_v")],
        *[F.when(last["n"] > 1, last[c]).otherwise(before[c.replace("pen", "last")]).alias(c) for c in ("pen_u", "pen_v")], corr.alias("corr"),
    )


def rate(samples: DataFrame, size, slide, bucket, keys: Sequence[str] = ("series_key",), extrapolate: bool = True, **kw) -> DataFrame:
    """``(keys, t, value)``: growth per second over each window, emitted when the watermark passes ``t``."""
    w = Timedelta(size).value // 1000
    v = W.increase_of(window_states(samples, size, slide, bucket, keys, **kw), w, keys, extrapolate)
    return v.withColumn("value", F.col("value") / F.lit(w / 1e6))


def irate(samples: DataFrame, size, slide, bucket, keys: Sequence[str] = ("series_key",), **kw) -> DataFrame:
    """``(keys, t, value)``: growth per second between the last two samples of each window."""
    return W.irate_of(window_states(samples, size, slide, bucket, keys, **kw), keys)
