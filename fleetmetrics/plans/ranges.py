"""Instant and range vectors, counters, forecasts (SEL5-SEL7, RV1-RV12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.matching import pivot_metrics
from .registry import CTR, G, M, RANGE, ctr, epoch, grid, grid_sql, m, query, r

_KEY = ["series_key"]


@query(
    "instant_grid",
    f"""with {M}, {G} select series_key, cast(epoch(t) as bigint) as t, round(arg_max(value, ts), 6) as value
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t group by series_key, t""",
)
def instant_grid(spark, sf):
    return W.instant(m(spark, sf), grid(spark, sf), RANGE).select("series_key", epoch().alias("t"), r("value").alias("value"))


@query(
    "offset_change",
    f"""with {M}, {G}, i as (select series_key, t, arg_max(value, ts) as v from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t
    group by series_key, t) select a.series_key, cast(epoch(a.t) as bigint) as t, round(a.v, 6) as value, round(b.v, 6) as before
    from i a join i b on a.series_key = b.series_key and b.t = a.t - interval 6 hour where a.v <> b.v""",
)
def offset_change(spark, sf):
    g = grid(spark, sf)
    both = W.with_offset(W.instant(m(spark, sf), g, RANGE), g, "6h")
    both = both.where((F.col("value") != F.col("before")) & (F.col("t") <= F.timestamp_micros(F.lit(g.end))))
    return both.select("series_key", epoch().alias("t"), r("value").alias("value"), r("before").alias("before"))


_OVER = """with {m}, {g} select series_key, cast(epoch(t) as bigint) as t, {agg} as value
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t group by series_key, t"""


def _over(fn, digits=4):
    def run(spark, sf):
        v = W.over_time(m(spark, sf), grid(spark, sf), RANGE, [fn])
        return v.select("series_key", epoch().alias("t"), r(fn, digits).alias("value"))

    return run


query("avg_over_time", _OVER.format(m=M, g=G, agg="round(avg(value), 9)"))(_over("avg", 9))
query("sum_over_time", _OVER.format(m=M, g=G, agg="round(sum(value), 4)"))(_over("sum", 4))
query("max_over_time", _OVER.format(m=M, g=G, agg="max(value)"))(_over("max", 6))
query("min_over_time", _OVER.format(m=M, g=G, agg="min(value)"))(_over("min", 6))


@query(
    "changes",
    f"""with {M}, {G}, d as (select series_key, t, ts, floor(value / 50) as v, lag(floor(value / 50)) over (partition by series_key, t order by ts, event_id) as p
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t)
    select series_key, cast(epoch(t) as bigint) as t, cast(sum(case when p is not null and v <> p then 1 else 0 end) as double) as value from d group by series_key, t""",
)
def changes(spark, sf):
    s = m(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return W.changes(s, grid(spark, sf), RANGE).select("series_key", epoch().alias("t"), "value")


# increase over R(1 day): neighbours are compared inside the window only
_INC = f"""with {CTR}, {G}, w as (select series_key, t, ts, value, lag(value) over (partition by series_key, t order by ts, event_id) as p
    from g join ctr on ctr.ts > g.t - interval 1 day and ctr.ts <= g.t),
  s as (select series_key, t, count(*) as n, min(ts) as f, max(ts) as l, arg_min(value, ts) as fv,
    sum(case when p is null then 0 when value < p then value else value - p end) as inc from w group by series_key, t having count(*) >= 2)"""


@query("increase_raw", _INC + " select series_key, cast(epoch(t) as bigint) as t, round(inc, 4) as value from s")
def increase_raw(spark, sf):
    return W.increase(ctr(spark, sf), grid(spark, sf), RANGE, extrapolate=False).select("series_key", epoch().alias("t"), r("value", 4).alias("value"))


@query("rate_raw", _INC + " select series_key, cast(epoch(t) as bigint) as t, round(inc / 86400.0, 9) as value from s")
def rate_raw(spark, sf):
    return W.rate(ctr(spark, sf), grid(spark, sf), RANGE, extrapolate=False).select("series_key", epoch().alias("t"), r("value", 9).alias("value"))


@query(
    "increase_extrap",
    _INC
    + """, e as (select *, epoch_us(l - f) / 1e6 as obs, epoch_us(l - f) / 1e6 / (n - 1) as av,
    epoch_us(f - (t - interval 1 day)) / 1e6 as h0, epoch_us(t - l) / 1e6 as e0 from s),
  e2 as (select *, case when h0 >= av * 1.1 then av / 2 else h0 end as h1, case when e0 >= av * 1.1 then av / 2 else e0 end as e1,
    case when inc > 0 and fv >= 0 then obs * (fv / inc) end as z from e)
  select series_key, cast(epoch(t) as bigint) as t, round(inc * ((obs + least(h1, coalesce(z, h1)) + e1) / obs), 7) as value from e2""",
)
def increase_extrap(spark, sf):
    return W.increase(ctr(spark, sf), grid(spark, sf), RANGE).select("series_key", epoch().alias("t"), r("value", 7).alias("value"))


_LAST2 = """w as (select series_key, t, ts, value, row_number() over (partition by series_key, t order by ts desc, event_id desc) as n
    from g join {src} x on x.ts > g.t - interval 1 day and x.ts <= g.t),
  p as (select series_key, t, max(case when n = 1 then value end) as v1, max(case when n = 2 then value end) as v2,
    max(case when n = 1 then ts end) as t1, max(case when n = 2 then ts end) as t2 from w where n <= 2 group by series_key, t having count(*) = 2)"""


@query(
    "irate_grid",
    f"""with {CTR}, {G}, {_LAST2.format(src='ctr')} select series_key, cast(epoch(t) as bigint) as t,
    round((case when v1 < v2 then v1 else v1 - v2 end) / (epoch_us(t1 - t2) / 1e6), 8) as value from p""",
)
def irate_grid(spark, sf):
    return W.irate(ctr(spark, sf), grid(spark, sf), RANGE).select("series_key", epoch().alias("t"), r("value", 8).alias("value"))


@query(
    "irate_total",
    f"""with {CTR}, {G}, {_LAST2.format(src='ctr')} select cast(epoch(t) as bigint) as t,
    round(sum((case when v1 < v2 then v1 else v1 - v2 end) / (epoch_us(t1 - t2) / 1e6)), 5) as value, count(*) as series from p
    where series_key like 'click|%' or series_key like 'view|%' group by t""",
)
def irate_total(spark, sf):
    """Total rate of two counters: both are rated in one pass and summed over everything."""
    s = ctr(spark, sf).where(F.col("metric").isin("click", "view"))
    v = W.irate(s, grid(spark, sf), RANGE).groupBy("t").agg(F.sum("value").alias("value"), F.count("*").alias("series"))
    return v.select(epoch().alias("t"), r("value", 5).alias("value"), "series")


@query(
    "idelta_grid",
    f"""with {M}, {G}, {_LAST2.format(src='m')} select series_key, cast(epoch(t) as bigint) as t, round(v1 - v2, 6) as value from p""",
)
def idelta_grid(spark, sf):
    return W.idelta(m(spark, sf), grid(spark, sf), RANGE).select("series_key", epoch().alias("t"), r("value").alias("value"))


@query(
    "delta_ratio",
    f"""with {CTR}, {G}, {_LAST2.format(src='ctr')}, q as (select split_part(series_key, '|', 2) as host, t,
    max(case when series_key like 'click|%' then v1 - v2 end) as a, max(case when series_key like 'view|%' then v1 - v2 end) as b from p group by 1, 2)
    select host, cast(epoch(t) as bigint) as t, round(a / b * 100, 5) as value from q where a is not null and b is not null and b <> 0""",
)
def delta_ratio(spark, sf):
    """Counter over counter: last differences of two metrics, matched on the remaining labels."""
    s = ctr(spark, sf).where(F.col("metric").isin("click", "view"))
    d = W.idelta(s, grid(spark, sf), RANGE, keys=["metric", "host"])
    both = pivot_metrics(d, ["click", "view"], ["host", "t"]).where(F.col("view") != 0)
    return both.select("host", epoch().alias("t"), r(F.col("click") / F.col("view") * 100, 5).alias("value"))


@query(
    "predict_linear",
    f"""with {M}, {G}, f as (select series_key, t, count(*) as n, arg_max(value, ts) as last_v,
    regr_intercept(value, epoch_us(ts - t) / 1e6) + regr_slope(value, epoch_us(ts - t) / 1e6) * 14400 as p
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t group by series_key, t having count(*) >= 2)
    select series_key, cast(epoch(t) as bigint) as t, round(p, 4) as value from f where p < 40 and last_v > 20""",
)
def predict_linear(spark, sf):
    s, g = m(spark, sf), grid(spark, sf)
    ahead = W.predict_linear(s, g, RANGE, "4h").where(F.col("value") < 40)
    used = W.instant(s, g, RANGE).where(F.col("value") > 20)
    both = ahead.join(used.select("series_key", "t"), ["series_key", "t"], "left_semi")
    return both.select("series_key", epoch().alias("t"), r("value", 4).alias("value"))


@query(
    "availability",
    f"""with {M}, {G} select series_key, cast(epoch(t) as bigint) as t, round(avg(case when value > 10 then 1.0 else 0.0 end), 6) as value
    from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t group by series_key, t having avg(case when value > 10 then 1.0 else 0.0 end) < 0.5""",
)
def availability(spark, sf):
    up = m(spark, sf).withColumn("value", F.when(F.col("value") > 10, 1.0).otherwise(0.0))
    v = W.over_time(up, grid(spark, sf), RANGE, ["avg"]).where(F.col("avg") < 0.5)
    return v.select("series_key", epoch().alias("t"), r("avg").alias("value"))


@query(
    "reduce_last_mean",
    f"""with {M}, {G}, i as (select series_key, t, arg_max(value, ts) as v from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t group by series_key, t)
    select series_key, round(arg_max(v, t), 6) as last_value, round(avg(v), 6) as mean_value from i group by series_key""",
)
def reduce_last_mean(spark, sf):
    v = W.instant(m(spark, sf), grid(spark, sf), RANGE)
    out = v.groupBy("series_key").agg(F.max_by("value", F.unix_micros("t")).alias("l"), F.avg("value").alias("a"))
    return out.select("series_key", r("l").alias("last_value"), r("a").alias("mean_value"))


_HOURLY = grid_sql("1 hour", "6 hour")


def _long_grid(spark, sf):
    return grid(spark, sf, "1h", "6h")


@query(
    "long_window",
    f"""with {M}, {_HOURLY} select series_key, cast(epoch(t) as bigint) as t, round(sum(value), 4) as sum, count(*) as count, min(value) as min, max(value) as max, round(arg_max(value, ts), 6) as last
    from g join m on m.ts > g.t - interval 10 day and m.ts <= g.t group by series_key, t""",
)
def long_window(spark, sf):
    """Ten days on an hourly grid: windows overlap so often that they are merged by doubling."""
    v = W.over_time(m(spark, sf), _long_grid(spark, sf), "10d", ["sum", "count", "min", "max", "last"])
    return v.select("series_key", epoch().alias("t"), r("sum", 4).alias("sum"), "count", "min", "max", r("last").alias("last"))


@query(
    "long_increase",
    f"""with {CTR}, {_HOURLY}, w as (select series_key, t, ts, value, lag(value) over (partition by series_key, t order by ts, event_id) as p from g join ctr on ctr.ts > g.t - interval 5 day and ctr.ts <= g.t)
    select series_key, cast(epoch(t) as bigint) as t, round(sum(case when p is null then 0 when value < p then value else value - p end), 4) as value from w group by 1, 2 having count(*) >= 2""",
)
def long_increase(spark, sf):
    return W.increase(ctr(spark, sf), _long_grid(spark, sf), "5d", extrapolate=False).select("series_key", epoch().alias("t"), r("value", 4).alias("value"))


_UNEVEN = "interval 86401 second"


@query(
    "uneven_window",
    f"""with {M}, {_HOURLY} select series_key, cast(epoch(t) as bigint) as t, round(sum(value), 4) as sum, count(*) as count, min(value) as min, max(value) as max, round(arg_max(value, ts), 6) as last
    from g join m on m.ts > g.t - {_UNEVEN} and m.ts <= g.t group by series_key, t""",
)
def uneven_window(spark, sf):
    """A day and a second on an hourly grid: the window is no whole number of steps."""
    v = W.over_time(m(spark, sf), _long_grid(spark, sf), "86401s", ["sum", "count", "min", "max", "last"])
    return v.select("series_key", epoch().alias("t"), r("sum", 4).alias("sum"), "count", "min", "max", r("last").alias("last"))


@query(
    "uneven_increase",
    f"""with {CTR}, {_HOURLY}, w as (select series_key, t, ts, value, lag(value) over (partition by series_key, t order by ts, event_id) as p from g join ctr on ctr.ts > g.t - {_UNEVEN} and ctr.ts <= g.t)
    select series_key, cast(epoch(t) as bigint) as t, round(sum(case when p is null then 0 when value < p then value else value - p end), 4) as value from w group by 1, 2 having count(*) >= 2""",
)
def uneven_increase(spark, sf):
    return W.increase(ctr(spark, sf), _long_grid(spark, sf), "86401s", extrapolate=False).select("series_key", epoch().alias("t"), r("value", 4).alias("value"))
