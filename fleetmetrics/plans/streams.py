"""Streaming jobs run to completion over the tables and compared with batch SQL (ST1-ST8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import drift
from ..sources.tables import event_samples, table, table_stream
from ..streaming import ingest, rollup, stateful
from ..timeutil import micros
from .registry import DAILY, G, M, bounds, epoch, grid, query, r


def _stream(spark, sf):
    return event_samples(table_stream(spark, sf, "events"))


def _batch(spark, sf):
    return event_samples(table(spark, sf, "events"))


def _watermark(spark, sf, back=0):
    """Where the stream of all events ends with a delay of one hour; ``back`` moves its event times."""
    newest = bounds(spark, sf)[1]
    return ingest.final_watermark(None if newest is None else newest - back, "1h")


def _since(samples, watermark, size):
    return samples.where(F.unix_micros("ts") > F.lit(watermark - micros(size)))


@query("stream_dedupe", f"with {M} select series_key, count(*) as n, round(sum(value), 4) as total from m group by 1")
def stream_dedupe(spark, sf):
    """Every sample arrives twice and is kept once."""
    twice = _stream(spark, sf).select("series_key", "ts", "value", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    out = ingest.run_to_table(ingest.dedupe(twice, delay="1 hour"), "dedupe")
    return out.groupBy("series_key").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query(
    "stream_window",
    f"""with {M}, g as (select unnest(generate_series(time_bucket(interval 6 hour, min(ts)), max(ts) + interval 1 day, interval 6 hour)) as t from m)
    select series_key, cast(epoch(t) as bigint) as t, round(avg(value), 9) as avg, round(sum(value), 4) as sum, max(value) as max, count(*) as count
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t group by series_key, t""",
)
def stream_window(spark, sf):
    def stats(samples):
        return ingest.window_stats(samples, size="1 day", slide="6 hours", delay="1 hour")

    w = _watermark(spark, sf, 1)
    out = ingest.with_open(ingest.run_to_table(stats(_stream(spark, sf)), "window"), stats(_since(_batch(spark, sf), w, "1d")), F.unix_micros("t"), w)
    return out.select("series_key", epoch().alias("t"), r("avg", 9).alias("avg"), r("sum", 4).alias("sum"), "max", "count")


@query(
    "stream_rate",
    f"""with {M}, {G}, w as (select series_key, t, ts, value, lag(value) over (partition by series_key, t order by ts, event_id) as p
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t)
    select series_key, cast(epoch(t) as bigint) as t, round(sum(case when p is null then 0 when value < p then value else value - p end), 4) as value from w group by 1, 2 having count(*) >= 2""",
)
def stream_rate(spark, sf):
    """Samples roll up into hourly counter states; daily growth is read from the states."""
    states = rollup.rollup_counters(_stream(spark, sf), "1h", delay="10m", flush=True)
    v = rollup.increase_from_states(states, "1h", grid(spark, sf), "1d", extrapolate=False)
    return v.select("series_key", epoch().alias("t"), r("value", 4).alias("value"))


@query(
    "stream_irate",
    f"""with {M}, {G}, w as (select series_key, t, ts, value, lag(value) over v as p, lag(ts) over v as q, row_number() over (partition by series_key, t order by ts desc, event_id desc) as i
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t window v as (partition by series_key, t order by ts, event_id))
    select series_key, cast(epoch(t) as bigint) as t, round(case when value < p then value else value - p end / (epoch_us(ts) - epoch_us(q)) * 1e6, 9) as value from w where i = 1 and q < ts""",
)
def stream_irate(spark, sf):
    """Growth between the last two samples of a day, read from streamed states."""
    states = rollup.rollup_counters(_stream(spark, sf), "1h", delay="10m", flush=True)
    return rollup.irate_from_states(states, "1h", grid(spark, sf), "1d").select("series_key", epoch().alias("t"), r("value", 9).alias("value"))


_ISLANDS = """s as (select series_key, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 4 hour then 1 else 0 end as b from m window w as (partition by series_key order by ts, event_id)),
  n as (select series_key, ts, sum(b) over (partition by series_key order by ts rows between unbounded preceding and current row) as i from s),
  x as (select series_key, min(ts) as a, max(ts) as z, count(*) as c from n group by series_key, i)"""


@query(
    "stream_absence",
    f"""with {M}, {_ISLANDS} select series_key, epoch_us(a) as up_since, epoch_us(z) as last_seen, epoch_us(z + interval 4 hour) as absent_since, c as samples from x""",
)
def stream_absence(spark, sf):
    """Sessions: up-time stretches, and the instants from which a series counts as absent."""
    def stretches(samples):
        return ingest.sessions(samples, gap="4 hours", delay="1 hour")

    out = ingest.run_to_table(stretches(_stream(spark, sf)), "absence", conf=ingest.SESSION_CONF)
    out = ingest.with_open(out, stretches(_batch(spark, sf)), F.unix_micros("last_seen") + micros("4h"), _watermark(spark, sf))
    return out.select("series_key", *[F.unix_micros(c).alias(c) for c in ("up_since", "last_seen", "absent_since")], "samples")


@query(
    "session_islands",
    f"with {M}, {_ISLANDS} select series_key, epoch_us(a) as up_since, epoch_us(z) as last_seen, epoch_us(z + interval 4 hour) as absent_since from x",
)
def session_islands(spark, sf):
    s = event_samples(table(spark, sf, "events"))
    out = ingest.sessions_batch(s, gap="4h", ties=["event_id"])
    return out.select("series_key", *[F.unix_micros(c).alias(c) for c in ("up_since", "last_seen", "absent_since")])


def _alert_table(spark, sf):
    """Daily averages stream into a table, which streams through the alert state machine."""
    def daily(samples):
        return ingest.window_stats(samples, size="1 day", slide="1 day", delay="1 hour")

    base = ingest.shared_dir(spark, "daily")
    w = _watermark(spark, sf, 1)
    days = ingest.with_open(ingest.run_to_table(daily(_stream(spark, sf)), "daily"), daily(_since(_batch(spark, sf), w, "1d")), F.unix_micros("t"), w)
    days.write.parquet(base)
    evals = spark.readStream.schema(days.schema).parquet(base).select("series_key", "t", (F.col("avg") > 49).alias("active"))
    states = ingest.run_to_table(stateful.alert_state_stream(evals, "1d", "1d", delay="0 seconds"), "alerts")
    end = days.agg(F.unix_micros(F.max("t"))).first()[0]
    return stateful.with_silent(states, F.timestamp_micros(F.lit(end).cast("bigint")), "1d")


_STATES = f"""{M}, {DAILY},
  h as (select series_key, t, avg(value) as v from g join m on ts > t - interval 1 day and ts <= t group by 1, 2 having avg(value) > 49),
  i as (select *, t - row_number() over (partition by series_key order by t) * interval 1 day as run from h),
  st as (select series_key, t, min(t) over (partition by series_key, run) as since from i)"""


@query(
    "stream_alert_state",
    f"""with {_STATES} select series_key, cast(epoch(t) as bigint) as t, cast(epoch(since) as bigint) as active_since, case when t - since >= interval 1 day then 'firing' else 'pending' end as alertstate from st""",
)
def stream_alert_state(spark, sf):
    out = _alert_table(spark, sf).where("alertstate <> 'resolved'")
    return out.select("series_key", epoch().alias("t"), epoch("active_since").alias("active_since"), "alertstate")


@query(
    "stream_notifications",
    f"""with {_STATES}, f as (select split_part(series_key, '|', 1) as a, series_key as s, t from st where t - since >= interval 1 day),
  n as (select a, t, count(*) as c, count(*) filter (not exists (select 1 from f p where p.s = f.s and p.t = f.t - interval 1 day)) as new from f group by 1, 2),
  e as (select a, t + interval 1 day as t, count(*) as resolved from f where t < (select max(t) from g)
    and not exists (select 1 from f q where q.s = f.s and q.t = f.t + interval 1 day) group by 1, 2),
  ch as (select coalesce(n.a, e.a) as a, coalesce(n.t, e.t) as t, coalesce(n.c, 0) as firing, coalesce(n.new, 0) as new, coalesce(e.resolved, 0) as resolved from n full join e on n.a = e.a and n.t = e.t),
  x as (select ch.*, (select max(y.t) from ch y where y.a = ch.a and y.t <= ch.t and y.new + y.resolved > 0) as lc from ch)
  select a as alertname, cast(epoch(t) as bigint) as sent_at, case when new + resolved > 0 then 'change' else 'repeat' end as reason, cast(firing as bigint) as firing, cast(new as bigint) as new,
    cast(resolved as bigint) as resolved from x where new + resolved > 0 or (epoch(t - lc) / 86400) % 2 = 0""",
)
def stream_notifications(spark, sf):
    """Notification log of the streamed alert states, grouped by metric."""
    base = ingest.shared_dir(spark, "states")
    states = _alert_table(spark, sf).withColumn("alertname", F.split_part("series_key", F.lit("|"), F.lit(1)))
    states.write.mode("overwrite").parquet(base)
    src = spark.readStream.schema(states.schema).parquet(base)
    log = stateful.notify_stream(src, ["alertname"], wait="0s", interval="1d", repeat="2d")
    return log.select("alertname", epoch("sent_at").alias("sent_at"), "reason", "firing", "new", "resolved")


@query(
    "stream_drift",
    """with e as (select concat('h', cast(user_id % 4 as varchar)) as host, date_trunc('day', ts) + interval 1 day as snap, event_type from events),
    s as (select host, snap, event_type as name, count(*) // 12 as setting from e group by 1, 2, 3),
    h as (select host, snap, md5(string_agg(concat(name, cast(setting as varchar)), ',' order by name)) as hash from s group by 1, 2),
    c as (select *, coalesce(cast(hash <> lag(hash) over (partition by host order by snap) as int), 0) as changed from h)
    select host, strftime(snap, '%Y-%m-%d') as t, hash, changed, max(changed) over (partition by host order by snap) as status from c""",
)
def stream_drift(spark, sf):
    """Settings stream in, closed days are hashed, and the hashes stream through the drift state."""
    def snapshots(samples):
        e = samples.withWatermark("ts", "1 hour").groupBy("host", "metric", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
        return e.select("host", F.col("window.end").alias("snapshot_ts"), F.col("metric").alias("name"), F.floor(F.col("n") / 12).cast("string").alias("setting"))

    base = ingest.shared_dir(spark, "drift")

    def hashes(batch, batch_id):
        # a day closes as a whole, so every snapshot is complete within its micro-batch
        drift.settings_hash(batch).select("host", "snapshot_ts", "hash").write.mode("overwrite").parquet(f"{base}/hashes/batch={batch_id}")

    stateful.each_batch(snapshots(_stream(spark, sf)), hashes, "drift", base)
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("snapshot_ts", T.TimestampType()), T.StructField("hash", T.StringType()), T.StructField("batch", T.LongType())])
    closed = spark.read.schema(schema).parquet(f"{base}/hashes").drop("batch")
    w = _watermark(spark, sf)
    open_ = drift.settings_hash(snapshots(_since(_batch(spark, sf), w, "1d"))).select("host", "snapshot_ts", "hash").where(F.unix_micros("snapshot_ts") > F.lit(w))
    open_.write.parquet(f"{base}/hashes/batch=-1")
    out = ingest.run_to_table(stateful.drift_stream(spark.readStream.schema(schema).parquet(f"{base}/hashes")), "drift-status")
    return out.select("host", F.date_format("snapshot_ts", "yyyy-MM-dd").alias("t"), "hash", "changed", "status")
