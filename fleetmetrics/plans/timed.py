"""Streams whose rows come from state and timers alone; the SQL ends where the last watermark does (ST3-ST6, ST8, AL9).

A file stream of one run sees its watermark at the newest instant less the delay, in whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import event_samples, table, table_stream
from ..streaming import ingest, rates, timers
from .registry import DAILY, G, M, bounds, epoch, query, r

_HOUR = 3_600_000_000
#: The watermark of a stream of all events with a delay of one hour, in microseconds.
_W = "w as (select (max(epoch_us(ts)) // 1000 - 3600000) * 1000 as w, min(epoch_us(ts)) // 86400000000 * 86400000000 as lo from events)"


def _stream(spark, sf):
    return event_samples(table_stream(spark, sf, "events"))


@query(
    "stream_deadman",
    f"""with {M}, {_W}, targets as (select distinct metric || '|' || h as series_key, lo from m, w, (select unnest(['h0', 'h1', 'h2', 'h3', 'h8', 'h9']) as h)),
  s as (select series_key, epoch_us(ts) as u, w from m, w where epoch_us(ts) <= w union all select series_key, w + 1, w from targets, w),
  q as (select s.*, t.lo, lag(case when u <= w then u end) over (partition by series_key order by u) as p from s join targets t using (series_key))
  select series_key, 'down' as event, coalesce(p, lo) + 28800000000 as at, p as last_seen from q where u > coalesce(p, lo) + 28800000000
  union all select series_key, 'up', u, p from q where u <= w and u > coalesce(p, lo) + 28800000000""",
)
def stream_deadman(spark, sf):
    """Six hosts are expected for each metric, two of which never send; eight hours of silence count."""
    hosts = F.explode(F.array(*[F.lit(h) for h in ("h0", "h1", "h2", "h3", "h8", "h9")]))
    lo = F.timestamp_micros(F.lit((bounds(spark, sf)[0] or 0) // (24 * _HOUR) * 24 * _HOUR))
    metrics = table(spark, sf, "events").select(F.col("event_type").alias("metric")).distinct()
    targets = metrics.select("metric", hosts.alias("host")).select(F.concat_ws("|", "metric", "host").alias("series_key"), lo.alias("since"))
    out = ingest.run_to_table(timers.dead_man(_stream(spark, sf), targets, "8h", delay="1 hour"), "deadman")
    return out.select("series_key", "event", F.unix_micros("at").alias("at"), F.unix_micros("last_seen").alias("last_seen"))


@query(
    "stream_rate_rows",
    f"""with {M}, {G}, {_W}, v as (select series_key, t, ts, value, lag(value) over (partition by series_key, t order by ts, event_id) as p
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t)
    select series_key, cast(epoch(t) as bigint) as t, round(sum(case when p is null then 0 when value < p then value else value - p end) / 86400, 9) as value from v, w
    where epoch_us(t) <= w group by 1, 2 having count(*) >= 2""",
)
def stream_rate_rows(spark, sf):
    """Daily rates every six hours, as rows of the stream."""
    out = ingest.run_to_table(rates.rate(_stream(spark, sf), "1 day", "6 hours", "1 hour", extrapolate=False, delay="1 hour"), "rates")
    return out.select("series_key", epoch().alias("t"), r("value", 9).alias("value"))


@query(
    "stream_role_epochs",
    f"""with {_W}, s as (select concat('u', cast(user_id as varchar)) as instance, case when value > 50 then 'primary' else 'replica' end as role, epoch_us(ts) as u from events, w where epoch_us(ts) <= w),
  c as (select *, case when lag(role) over (partition by instance order by u) = role then 0 else 1 end as b from s),
  n as (select *, sum(b) over (partition by instance order by u rows between unbounded preceding and current row) as i from c),
  e as (select instance, i, min(role) as role, min(u) as since, max(u) as last_seen, count(*) as samples from n group by instance, i)
  select instance, role, since, last_seen, samples, lead(since) over x as ended_at, lead(role) over x as next_role from e window x as (partition by instance order by i) qualify ended_at is not null""",
)
def stream_role_epochs(spark, sf):
    """Epochs of a role that each instance reports."""
    samples = table_stream(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("instance"), F.when(F.col("value") > 50, "primary").otherwise("replica").alias("role"), "ts")
    out = ingest.run_to_table(timers.epochs(samples, "role", ["instance"], delay="1 hour"), "epochs")
    return out.select("instance", "role", *[F.unix_micros(c).alias(c) for c in ("since", "last_seen", "ended_at")], "samples", F.col("next_value").alias("next_role"))


def _firing(spark, sf, name):
    """Daily averages stream into a table; its stream meets the rules and goes through the alert states."""
    days = ingest.run_to_table(ingest.window_stats(_stream(spark, sf), size="1 day", slide="1 day", delay="1 hour"), f"{name}-daily")
    base = ingest.shared_dir(spark, f"{name}-evals")
    days.write.parquet(base)
    tiers = [("warning", 49.0, 2 * 86400), ("critical", 52.0, 86400)]
    rules = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(x).alias("threshold"), F.lit(h).alias("hold")) for s, x, h in tiers])
    evals = spark.readStream.schema(days.schema).parquet(base).select("*", F.inline(rules))
    metric, host = (F.split_part("series_key", F.lit("|"), F.lit(i)) for i in (1, 2))
    service = F.when(metric.isin("error", "signup"), "system").otherwise("postgresql")
    evals = evals.select(F.concat(F.lit("High_"), metric).alias("alertname"), "severity", host.alias("host"), service.alias("service"), F.concat(F.lit("j"), F.substring(host, 2, 1)).alias("job"), "t", (F.col("avg") > F.col("threshold")).alias("active"), "hold")
    keys = ["alertname", "severity", "host", "service", "job"]
    states = ingest.run_to_table(timers.alert_states(evals, "1d", keys, delay="0 seconds"), f"{name}-states")
    base = ingest.shared_dir(spark, f"{name}-in")
    states.write.parquet(base)
    return spark.readStream.schema(states.schema).parquet(base)


_FIRING = f"""{M}, {DAILY}, {_W}, d as (select metric, host, t, avg(value) as v from w, g join m on ts > t - interval 1 day and ts <= t where epoch_us(t) <= w group by 1, 2, 3),
  h as (select concat('High_', metric) as alertname, y.severity, host, t, hold, case when metric in ('error', 'signup') then 'system' else 'postgresql' end as service
    from d, (values ('warning', 49.0, 2), ('critical', 52.0, 1)) y(severity, threshold, hold) where v > threshold),
  i as (select *, t - row_number() over (partition by alertname, severity, host order by t) * interval 1 day as run from h),
  st as (select *, min(t) over (partition by alertname, severity, host, run) as since from i),
  f as (select * from st where t - since >= hold * interval 1 day)"""


@query(
    "stream_inhibit",
    f"""with {_FIRING} select alertname, host, cast(epoch(t) as bigint) as t from f a where severity = 'warning' and not exists
    (select 1 from f b where b.severity = 'critical' and b.alertname = a.alertname and b.host = a.host and b.t = a.t) and t < (select max(t) from d)""",
)
def stream_inhibit(spark, sf):
    """Warnings that no critical alert of the same name, job and service mutes, by a stream-stream join.

    Those of the newest day wait for a later watermark.
    """
    firing = _firing(spark, sf, "inhibit").where("alertstate = 'firing'")
    out = ingest.run_to_table(timers.inhibit(firing, "1d", delay="0 seconds"), "inhibited")
    return out.select("alertname", "host", epoch().alias("t"))


@query(
    "stream_repeat",
    f"""with {M}, {DAILY}, {_W}, d as (select series_key, t, avg(value) as v from w, g join m on ts > t - interval 1 day and ts <= t where epoch_us(t) <= w group by 1, 2),
  i as (select *, t - row_number() over (partition by series_key order by t) * interval 1 day as run from d where v > 49),
  st as (select *, min(t) over (partition by series_key, run) as since from i),
  f as (select split_part(series_key, '|', 1) as a, series_key as s, t from st where t - since >= interval 1 day),
  last as (select max(t) as t from d),
  n as (select a, t, count(*) as c, count(*) filter (not exists (select 1 from f p where p.s = f.s and p.t = f.t - interval 1 day)) as new from f group by 1, 2),
  e as (select a, t + interval 1 day as t, count(*) as resolved from f where t < (select t from last) and not exists (select 1 from f q where q.s = f.s and q.t = f.t + interval 1 day) group by 1, 2),
  ch as (select coalesce(n.a, e.a) as a, coalesce(n.t, e.t) as t, coalesce(n.c, 0) as firing, coalesce(n.new, 0) as new, coalesce(e.resolved, 0) as resolved from n full join e on n.a = e.a and n.t = e.t),
  x as (select ch.*, (select max(y.t) from ch y where y.a = ch.a and y.t <= ch.t and y.new + y.resolved > 0) as lc from ch)
  select a as alertname, cast(epoch(t) as bigint) as sent_at, case when new + resolved > 0 then 'change' else 'repeat' end as reason, cast(firing as bigint) as firing, cast(new as bigint) as new,
    cast(resolved as bigint) as resolved from x where new + resolved > 0 or (epoch(t - lc) / 86400) % 2 = 0""",
)
def stream_repeat(spark, sf):
    """Notifications by timers: changes are sent at the daily flush, a group that stays as it is every two days."""
    days = ingest.run_to_table(ingest.window_stats(_stream(spark, sf), size="1 day", slide="1 day", delay="1 hour"), "repeat-daily")
    base = ingest.shared_dir(spark, "repeat-evals")
    days.select("series_key", "t", (F.col("avg") > 49).alias("active"), F.lit(86400).alias("hold")).write.parquet(base)
    evals = spark.readStream.schema("series_key string, t timestamp, active boolean, hold int").parquet(base)
    states = ingest.run_to_table(timers.alert_states(evals, "1d", delay="0 seconds"), "repeat-states")
    base = ingest.shared_dir(spark, "repeat-in")
    states.withColumn("alertname", F.split_part("series_key", F.lit("|"), F.lit(1))).write.parquet(base)
    src = spark.readStream.schema(spark.read.parquet(base).schema).parquet(base)
    log = ingest.run_to_table(timers.notify(src, ["alertname"], wait="0s", interval="1d", repeat="2d", delay="0 seconds"), "repeat-log")
    return log.select("alertname", epoch("sent_at").alias("sent_at"), "reason", "firing", "new", "resolved")
