"""Continuous roll-up of counters: samples stream in, ordered bucket states come out.

Counter growth needs neighbours in time order, which arrive late and across micro-batches.  So a
micro-batch first stores its samples, and then every chunk of time that the watermark has closed
is folded once with the batch operator.  Replaying a batch overwrites its own folders, so the
result does not depend on restarts.  Rates for any window are read from the states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import windows as W
from ..session import drop_folder, shared_dir
from ..timeutil import micros

# what a micro-batch leaves for the next one; ``open`` lists the batches with rows not folded yet
# (``done`` those folded by this one, which no replay needs once it is committed)
_MARK = "seen_us bigint, closed_us bigint, open array<struct<batch:bigint,max_us:bigint>>, done array<bigint>"


def rollup_counters(
    samples: DataFrame, bucket, keys: Sequence[str] = ("series_key",), delay="10m", value: str = "value", ts: str = "ts", path: str | None = None, flush: bool = False,
) -> DataFrame:
    """Run the available samples into closed bucket states and return the state table.

    With ``flush`` the buckets that are still open are folded as well, on reading and without being
    stored, for inputs that are known to be finished.

    A micro-batch reads the mark of the batch before it and the folders that still hold open
    rows, so its work does not grow with the age of the stream; folded samples are dropped.
    """
    spark = samples.sparkSession
    base = path or shared_dir(spark, "rollup")
    size, late = micros(bucket), micros(delay)
    flat = samples.select(*keys, F.unix_micros(ts).alias("_u"), F.col(value).cast("double").alias("_v")).where("_v is not null")

    def step(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        mark = s.read.schema(_MARK).parquet(f"{base}/marks/batch={batch_id - 1}").first() if batch_id else None
        seen, closed, held = (mark["seen_us"], mark["closed_us"], [tuple(x) for x in mark["open"]]) if mark else (None, None, [])
        done: list[int] = []
        fresh = batch if closed is None else batch.where(F.col("_u") > F.lit(closed))  # later than the watermark allows: dropped
        fresh.groupBy(*keys, "_u").agg(F.max("_v").alias("_v")).write.mode("overwrite").parquet(f"{base}/samples/batch={batch_id}")
        newest = s.read.schema(flat.schema).parquet(f"{base}/samples/batch={batch_id}").agg(F.max("_u")).first()[0]
        if newest is not None:
            held.append((batch_id, newest))
            seen = newest if seen is None else max(seen, newest)
        upto = None if seen is None else (seen - late) // size * size
        if upto is not None and (closed is None or upto > closed):
            due = s.read.schema(flat.schema).parquet(*[f"{base}/samples/batch={b}" for b, _ in held]).where(F.col("_u") <= F.lit(upto))
            due = due if closed is None else due.where(F.col("_u") > F.lit(closed))
            # the same sample may have come in two batches
            due = due.groupBy(*keys, "_u").agg(F.max("_v").alias("_v"))
            W.counter_states(due, keys, size).write.mode("overwrite").parquet(f"{base}/states/batch={batch_id}")
            done = [b for b, m in held if m <= upto]
            closed, held = upto, [(b, m) for b, m in held if m > upto]
        elif batch_id == 0:  # an empty state table keeps readers simple
            W.counter_states(fresh.limit(0), keys, size).write.mode("overwrite").parquet(f"{base}/states/batch=0")
        s.createDataFrame([(seen, closed, held, done)], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}")
        for b in mark["done"] if mark else ():
            drop_folder(s, f"{base}/samples/batch={b}")

    q = flat.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    states = read_states(spark, base, flat.select(*keys).schema)
    if not flush:
        return states
    batch = spark.read.schema("batch bigint, seen_us bigint, closed_us bigint, open array<struct<batch:bigint,max_us:bigint>>").parquet(f"{base}/marks").orderBy(F.desc("batch")).first()
    if batch is None or not batch["open"]:
        return states
    held = spark.read.schema(flat.schema).parquet(*[f"{base}/samples/batch={x['batch']}" for x in batch["open"]])
    held = held if batch["closed_us"] is None else held.where(F.col("_u") > F.lit(batch["closed_us"]))
    due = held.groupBy(*keys, "_u").agg(F.max("_v").alias("_v"))
    return states.unionByName(W.counter_states(due, keys, size).select(*states.columns))


_STATE = T.StructType(
    [
        T.StructField("_b", T.LongType()), T.StructField("n", T.LongType()), T.StructField("first_u", T.LongType()), T.StructField("first_v", T.DoubleType()),
        T.StructField("last_u", T.LongType()), T.StructField("last_v", T.DoubleType()), T.StructField("pen_u", T.LongType()), T.StructField("pen_v", T.DoubleType()),
        T.StructField("corr", T.DoubleType()), T.StructField("chg", T.LongType()),
    ]
)


def read_states(spark: SparkSession, base: str, key_schema: T.StructType) -> DataFrame:
    schema = T.StructType([*key_schema.fields, *_STATE.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(f"{base}/states").drop("batch")


def irate_from_states(states: DataFrame, bucket, grid: W.Grid, window, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """``irate`` on any grid and window that are multiples of the bucket."""
    return W.irate_of(_windows(states, bucket, grid, window, keys), keys)


def rate_from_states(states: DataFrame, bucket, grid: W.Grid, window, keys: Sequence[str] = ("series_key",), extrapolate: bool = True) -> DataFrame:
    """``rate``: the increase per second of the window."""
    v = increase_from_states(states, bucket, grid, window, keys, extrapolate)
    return v.withColumn("value", F.col("value") / F.lit(micros(window) / 1e6))


def increase_from_states(states: DataFrame, bucket, grid: W.Grid, window, keys: Sequence[str] = ("series_key",), extrapolate: bool = True) -> DataFrame:
    """``increase`` on any grid and window that are multiples of the bucket."""
    return W.increase_of(_windows(states, bucket, grid, window, keys), micros(window), keys, extrapolate)


def _windows(states: DataFrame, bucket, grid: W.Grid, window, keys: Sequence[str]) -> DataFrame:
    size, w = micros(bucket), micros(window)
    if grid.step % size or w % size:
        raise ValueError("step and window have to be multiples of the bucket")
    lo, hi = grid.first * grid.step - w, grid.last * grid.step
    need = states.where((F.col("_b") * F.lit(size) > F.lit(lo)) & (F.col("_b") * F.lit(size) <= F.lit(hi)))
    return W.window_states(W.link_states(need, keys), size, grid, w, keys)
