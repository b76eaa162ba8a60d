"""Keyed state machines over small streams: alert states, configuration drift, notifications.

These run on evaluations, hashes and transitions, of which a key has at most one for each step, not on
raw samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from . import timers
from ..alerts import routing
from ..session import drop_folder, settings, shared_dir, state_partitions
from ..timeutil import micros


def _keyed_schema(df: DataFrame, keys: Sequence[str], extra: list[T.StructField]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *extra])


def alert_state_stream(evals: DataFrame, step, hold, keys: Sequence[str] = ("series_key",), delay="10 minutes") -> DataFrame:
    """pending / firing / resolved from a stream of evaluations ``(keys, t, active, value)``.

    State per alert: start of the current activation and the last instant. Evaluations wait until the
    watermark has passed them, so one that comes late, within ``delay``, counts as if it had come in
    time. One that fails, a missed step, or silence beyond the watermark ends the activation.
    """
    held = evals.withColumn("hold", F.lit(micros(hold) // 1_000_000))
    return timers.alert_states(held, step, keys, delay=delay).drop("changed")


def with_silent(states: DataFrame, end: Column, step, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """Alert states of a finished input with the ends that no watermark reached any more: a firing alert
    whose series falls silent is resolved a step after its last instant, unless that is after ``end``,
    the newest instant of the input."""
    runs = states.groupBy(*keys, "active_since").agg(F.max(F.when(F.col("alertstate") == "firing", F.col("t"))).alias("_last"), F.count_if(F.col("alertstate") == "resolved").alias("_ended"))
    t = F.timestamp_micros(F.unix_micros("_last") + F.lit(micros(step)))
    silent = runs.where(F.col("_last").isNotNull() & (F.col("_ended") == 0)).select(*keys, t.alias("t"), "active_since", F.lit("resolved").alias("alertstate"))
    return states.unionByName(silent.where(F.col("t") <= end))


def drift_stream(hashes: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Sticky drift status from a stream of configuration hashes ``(host, snapshot_ts, hash)``."""
    out = _keyed_schema(hashes, keys, [T.StructField("t_us", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("changed", T.IntegerType()), T.StructField("status", T.IntegerType())])
    names = out.fieldNames()

    def advance(key, pdfs, state):
        stored, valid, last = state.get if state.exists else (None, 0, None)
        rows = []
        batch = pd.concat(list(pdfs)).sort_values("t_us", kind="stable")
        for t, h in zip(batch["t_us"].tolist(), batch["hash"].tolist()):
            if last is not None and t <= last:
                continue
            changed = int(stored is not None and h != stored)
            valid = max(valid, changed)
            stored, last = h, t
            rows.append((*key, t, h, changed, valid))
        state.update((stored, valid, last))
        yield pd.DataFrame(rows, columns=names)

    flat = hashes.select(*keys, F.unix_micros("snapshot_ts").alias("t_us"), "hash")
    s = flat.groupBy(*keys).applyInPandasWithState(advance, out, "hash string, valid int, last long", "append", GroupStateTimeout.NoTimeout)
    return s.select(*keys, F.timestamp_micros("t_us").alias("snapshot_ts"), "hash", "changed", "status")


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], name: str, path: str | None = None) -> str:
    """Run ``step(batch, id)`` over everything available; returns the folder it works in."""
    base = path or shared_dir(stream.sparkSession, name)
    spark = stream.sparkSession
    with settings(spark, **{"spark.sql.shuffle.partitions": state_partitions(spark)}):
        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return base


def notify_stream(states: DataFrame, group: Sequence[str], member: Sequence[str] = ("series_key",), path: str | None = None, late="1d", **timing) -> DataFrame:
    """Notification log from a stream of alert states ``(group, member, t, active_since, alertstate)``.

    A micro-batch reads what the one before it left, the firing stretches of groups that are open or
    were given up less than ``late`` ago, and appends the notifications that fall due after those
    already sent. So its work follows the open alerts, not the age of the stream; states may come
    up to ``late`` after newer ones. Folders are overwritten on replay, so nothing is sent twice, and
    dropped once no replay can need them.
    """
    spark = states.sparkSession
    base = path or shared_dir(spark, "notify")
    keys = [*group, *member, "active_since"]
    flat = states.select(*keys, "t", "alertstate")
    schema = T.StructType([*flat.select(*keys).schema.fields, *[T.StructField(n, T.TimestampType()) for n in ("fired_at", "resolved_at")]])
    pace = {k: v for k, v in timing.items() if k in ("wait", "interval")}

    def instant(us: int) -> Column:
        return F.timestamp_micros(F.lit(us).cast("bigint"))

    def advance(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession

        def folder(kind: str, back: int = 0) -> str:
            return f"{base}/{kind}/batch={batch_id - back}"

        def first(state: str) -> Column:
            return F.min(F.when(F.col("alertstate") == state, F.col("t")))

        # one row for each stretch and batch, however many evaluations it has
        new = batch.groupBy(*keys).agg(first("firing").alias("fired_at"), first("resolved").alias("resolved_at"), F.max("t").alias("seen"))
        new.write.mode("overwrite").parquet(folder("new"))
        fresh = s.read.schema(T.StructType([*schema.fields, T.StructField("seen", T.TimestampType())])).parquet(folder("new"))
        now = fresh.agg(F.unix_micros(F.max("seen"))).first()[0]
        known, before = fresh.drop("seen"), None
        if batch_id:
            before = s.read.schema("seen_us bigint").parquet(folder("marks", 1)).first()[0]
            known = known.unionByName(s.read.schema(schema).parquet(folder("open", 1)))
        now = max((u for u in (before, now) if u is not None), default=0)  # nothing has arrived yet: the log stays empty
        merged = known.groupBy(*keys).agg(F.min("fired_at").alias("fired_at"), F.min("resolved_at").alias("resolved_at"))
        fired = merged.where("fired_at is not null")
        due = routing.notifications(fired, group, member, until=instant(now), **timing)
        if before is not None:
            due = due.where(F.col("sent_at") > instant(before))
        due.write.mode("overwrite").parquet(folder("log"))
        since = instant(now - micros(late))
        early = merged.where(F.col("fired_at").isNull() & (F.col("resolved_at") >= since))  # the end came before the start
        routing.open_lives(fired, group, since, **pace).select(*merged.columns).unionByName(early).write.mode("overwrite").parquet(folder("open"))
        s.createDataFrame([(now,)], "seen_us bigint").coalesce(1).write.mode("overwrite").parquet(folder("marks"))
        for kind, back in (("new", 1), ("open", 2), ("marks", 2)):
            if batch_id >= back:
                drop_folder(s, folder(kind, back))

    each_batch(flat, advance, "notify", base)
    sent = T.StructType(
        [
            *[flat.schema[g] for g in group], T.StructField("sent_at", T.TimestampType()), T.StructField("reason", T.StringType()),
            *[T.StructField(n, T.LongType()) for n in ("firing", "new", "resolved", "batch")],
        ]
    )
    return spark.read.schema(sent).parquet(f"{base}/log").drop("batch")
