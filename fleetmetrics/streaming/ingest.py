"""Sample streams: de-duplication, window statistics, sessions, and running a stream to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pandas import Timedelta
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.neighbours import with_previous
from ..operators.selectors import largest
from ..session import settings, shared_dir, state_partitions
from ..timeutil import micros
from .timers import CONF


# sessions of a busy series are merged in every task before the shuffle
SESSION_CONF = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def run_to_table(stream: DataFrame, name: str, path: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Process everything available into a Parquet table and read it back.

    Table and checkpoint lie in the cluster's shared folder; a restarted run with the same path
    continues after the last committed batch.  ``conf`` holds for this query only.
    """
    spark = stream.sparkSession
    base = path or shared_dir(spark, name)
    with settings(spark, **{"spark.sql.shuffle.partitions": state_partitions(spark)} | CONF | (conf or {})):
        q = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/table")
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return read_table(spark, f"{base}/table", stream.schema)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A streaming output table, also when no batch has written to it yet."""
    return spark.read.schema(schema).parquet(path)


def final_watermark(newest_us: int | None, delay) -> int:
    """The last watermark of a finished input, from its newest event time: whole milliseconds, as in Spark."""
    return 0 if newest_us is None else (newest_us // 1000 - micros(delay) // 1000) * 1000


def with_open(closed: DataFrame, batch: DataFrame, end: Column, watermark: int) -> DataFrame:
    """Final flush of a finished input: the rows a stream has emitted, and those it still holds open.

    A stream emits a window or session once its watermark has passed the ``end`` of it (microseconds), so
    those that end later stay in its state. The end of a session has to be told by its last sample: a
    condition on the session window itself would reach the samples before they are merged. Exactly these are taken from ``batch``, the same frame over the stored
    samples; whatever the stream owed before its last watermark has to come from the stream. They are
    not stored: a stream that goes on will emit them itself.
    """
    return closed.unionByName(batch.select(*closed.columns).where(end > F.lit(watermark)))


def dedupe(samples: DataFrame, keys: Sequence[str] = ("series_key",), ts: str = "ts", delay="10 minutes") -> DataFrame:
    """First sample per (series, ts); state is dropped once the watermark has passed.

    The shuffle is by (series, ts), so a busy series spreads over all tasks.
    """
    return samples.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def window_stats(samples: DataFrame, keys: Sequence[str] = ("series_key",), size="5 minutes", slide="1 minute", delay="10 minutes", value: str = "value", ts: str = "ts") -> DataFrame:
    """avg, sum, min, max and count over ``(t - size, t]`` for every multiple ``t`` of ``slide``.

    Built-in windows are closed at the start; event time moved back by one microsecond gives the
    windows that are closed at the end.  Samples are first folded into panes one slide wide, and only
    panes are copied to the windows that hold them.
    """
    moved = samples.withColumn("_w", F.col(ts) - F.expr("interval 1 microsecond")).withWatermark("_w", delay)
    panes = moved.groupBy(*keys, F.window("_w", slide).alias("_pane")).agg(
        F.sum(value).alias("sum"), F.min(value).alias("min"), largest(F.col(value)).alias("max"), F.count(value).alias("count")
    )
    if Timedelta(size) % Timedelta(slide):
        raise ValueError("the size has to be a multiple of the slide")
    if Timedelta(size) == Timedelta(slide):
        out = panes.withColumnRenamed("_pane", "window")
    else:
        g = panes.groupBy(*keys, F.window(F.window_time("_pane"), size, slide))
        out = g.agg(F.sum("sum").alias("sum"), F.min("min").alias("min"), largest(F.col("max")).alias("max"), F.sum("count").alias("count"))
    return out.select(*keys, F.col("window.end").alias("t"), (F.col("sum") / F.col("count")).alias("avg"), "sum", "min", "max", "count")


def sessions(samples: DataFrame, keys: Sequence[str] = ("series_key",), gap="5 minutes", delay="10 minutes", ts: str = "ts") -> DataFrame:
    """Unbroken stretches of a series as a stream: emitted once the series has been silent for ``gap``.

    The same frame serves for up-time sessions and as a dead-man's switch: a closed session says
    that the series has been absent since ``absent_since``.
    """
    g = samples.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap))
    out = g.agg(F.min(ts).alias("up_since"), F.max(ts).alias("last_seen"), F.count("*").alias("samples"))
    return out.select(*keys, "up_since", "last_seen", F.col("session_window.end").alias("absent_since"), "samples")


def sessions_batch(samples: DataFrame, keys: Sequence[str] = ("series_key",), gap="5m", ts: str = "ts", ties: Sequence[str] = (), chunk="1h") -> DataFrame:
    """The batch twin: only session starts are ordered per series, samples per chunk of time."""
    g = micros(gap)
    prev = with_previous(samples.select(*keys, ts, *ties), keys, ts, [ts], ties, chunk, prefix="_p_")
    silent = F.unix_micros(ts) - F.unix_micros(f"_p_{ts}")
    starts = prev.where(F.col(f"_p_{ts}").isNull() | (silent >= F.lit(g))).select(*keys, F.col(ts).alias("up_since"), F.col(f"_p_{ts}").alias("_before"))
    ends = samples.groupBy(*keys).agg(F.max(ts).alias("_end"))
    w = Window.partitionBy(*keys).orderBy("up_since")
    out = starts.withColumn("_next", F.lead("_before").over(w)).join(ends, list(keys))
    last = F.coalesce("_next", "_end")
    return out.select(*keys, "up_since", last.alias("last_seen"), F.timestamp_micros(F.unix_micros(last) + F.lit(g)).alias("absent_since"))
