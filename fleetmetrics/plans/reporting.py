"""Dashboard panels over labelled samples (DS1) and stored tables (SRC2, SNK1, SNK2, CD4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import refresh
from ..reports.dashboard import dashboard
from ..reports.panels import Panel, evaluate_panel
from ..session import shared_dir
from ..sources import logs, samples as smp
from ..sources.tables import table
from .registry import CTR, G, M, RANGE, bounds, ctr, epoch, grid, m, query, r
from .selecting import log_lines


def _labelled(df):
    labels = F.create_map(F.lit("host"), F.col("host"), F.lit("kind"), F.substring("metric", 1, 1))
    return df.select("metric", labels.alias("labels"), "ts", "value")


def _panel(spark, sf, samples, panel, **picked):
    v = evaluate_panel(samples, panel, grid(spark, sf), RANGE, **picked)
    return v.select("series_key", epoch().alias("t"), r("value", 5).alias("value"))


def _one_kind(df):
    """Two metrics that share all labels."""
    return df.select("metric", F.create_map(F.lit("host"), F.col("host")).alias("labels"), "ts", "value")


_I = f"""{M}, {G}, i as (select metric, host, t, arg_max(value, ts) as v from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t group by 1, 2, 3)"""


@query(
    "panel_instant",
    f"""with {_I} select concat('{{"host":"', host, '","kind":"c"}}') as series_key, cast(epoch(t) as bigint) as t, round(v, 5) as value from i where metric = 'click' and host in ('h1', 'h2')""",
)
def panel_instant(spark, sf):
    return _panel(spark, sf, _labelled(m(spark, sf)), Panel("click", vars=(("node", "host", "=~"),)), node="h1|h2")


@query(
    "panel_ratio",
    f"""with {_I} select concat('{{"host":"', host, '"}}') as series_key, cast(epoch(t) as bigint) as t, round(100 - 100 * (max(case when metric = 'click' then v end) / max(case when metric = 'view' then v end)), 5) as value
    from i where metric in ('click', 'view') group by host, t having count(*) = 2 and max(case when metric = 'view' then v end) <> 0""",
)
def panel_ratio(spark, sf):
    return _panel(spark, sf, _one_kind(m(spark, sf)), Panel("click", metric2="view", form="free_pct"))


@query(
    "panel_ratio_of_sums",
    f"""with {_I} select '{{}}' as series_key, cast(epoch(t) as bigint) as t, round(100 * (sum(case when metric = 'click' then v end) / sum(case when metric = 'view' then v end)), 5) as value
    from i where metric in ('click', 'view') group by t having count(distinct metric) = 2""",
)
def panel_ratio_of_sums(spark, sf):
    return _panel(spark, sf, _one_kind(m(spark, sf)), Panel("click", metric2="view", form="pct", agg="sum", agg_first=True))


@query(
    "panel_sum_over_time",
    f"""with {M}, {G} select '{{"kind":"c"}}' as series_key, cast(epoch(t) as bigint) as t, round(sum(value), 4) as value from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t where metric = 'click' group by t""",
)
def panel_sum_over_time(spark, sf):
    p = Panel("click", "sum_over_time", RANGE, agg="sum", without=("host",))
    v = evaluate_panel(_labelled(m(spark, sf)), p, grid(spark, sf), RANGE)
    return v.select("series_key", epoch().alias("t"), r("value", 4).alias("value"))


@query(
    "panel_irate_by",
    f"""with {CTR}, {G}, w as (select series_key, metric, t, ts, value, row_number() over (partition by series_key, t order by ts desc, event_id desc) as n from g join ctr on ctr.ts > g.t - interval 1 day and ctr.ts <= g.t where metric = 'view'),
    p as (select series_key, t, max(case when n = 1 then value end) as v1, max(case when n = 2 then value end) as v2, max(case when n = 1 then ts end) as t1, max(case when n = 2 then ts end) as t2 from w where n <= 2 group by 1, 2 having count(*) = 2)
    select '{{"kind":"v"}}' as series_key, cast(epoch(t) as bigint) as t, round(sum((case when v1 < v2 then v1 else v1 - v2 end) / (epoch_us(t1 - t2) / 1e6)), 5) as value from p group by t""",
)
def panel_irate_by(spark, sf):
    return _panel(spark, sf, _labelled(ctr(spark, sf)), Panel("view", "irate", RANGE, agg="sum", by=("kind",)))


@query(
    "panel_groups",
    f"""with {_I} select cast(epoch(t) as bigint) as t, count(distinct host)::double as value from i where metric = 'error' group by t""",
)
def panel_groups(spark, sf):
    v = evaluate_panel(_labelled(m(spark, sf)), Panel("error", agg="groups", by=("host",)), grid(spark, sf), RANGE)
    return v.select(epoch().alias("t"), "value")


@query(
    "panel_top",
    f"""with {_I} select concat('{{"host":"', host, '","kind":"p"}}') as series_key, cast(epoch(t) as bigint) as t, round(v * 512, 5) as value from i where metric = 'purchase' and v * 512 > 40000""",
)
def panel_top(spark, sf):
    return _panel(spark, sf, _labelled(m(spark, sf)), Panel("purchase", scale=512, above=40000))


_HOSTS = "concat('{\"host\":\"', host, '\"}')"


@query(
    "dashboard_pass",
    f"""with {_I}, w as (select metric, host, t, avg(value) as av, sum(value) as s, max(value) as hi, sum(case when p is null then 0 when value < p then value else value - p end) as grown, count(*) as n
      from (select metric, host, t, value, lag(value) over (partition by metric, host, t order by ts, event_id) as p from g join m on m.ts > g.t - interval 1 day and m.ts <= g.t) group by 1, 2, 3),
    x as (select 'newest' as panel, {_HOSTS} as series_key, t, v as value from i where metric = 'click' and host in ('h1', 'h2')
      union all select 'scaled', {_HOSTS}, t, v * 512 from i where metric = 'purchase' and v * 512 > 40000
      union all select 'free', {_HOSTS}, t, 100 - 100 * (max(case when metric = 'click' then v end) / max(case when metric = 'view' then v end)) from i
        where metric in ('click', 'view') group by host, t having count(*) = 2 and max(case when metric = 'view' then v end) <> 0
      union all select 'hosts', '{{}}', t, count(distinct host) from i where metric = 'error' group by t
      union all select 'average', {_HOSTS}, t, av from w where metric = 'view'
      union all select 'total', '{{}}', t, sum(s) from w where metric = 'signup' and host <> 'h3' group by t
      union all select 'highest', '{{}}', t, max(hi) from w where metric = 'error' group by t)
    select panel, series_key, cast(epoch(t) as bigint) as t, round(value, 9) as value from x""",
)
def dashboard_pass(spark, sf):
    """Seven panels of one window from one scan and one set of states."""
    panels = {
        "newest": Panel("click", vars=(("node", "host", "=~"),)), "scaled": Panel("purchase", scale=512, above=40000), "free": Panel("click", metric2="view", form="free_pct"),
        "hosts": Panel("error", agg="groups", by=("host",)), "average": Panel("view", "avg_over_time", RANGE), "total": Panel("signup", "sum_over_time", RANGE, agg="sum", matchers=(("host", "!=", "h3"),)),
        "highest": Panel("error", "max_over_time", RANGE, agg="max"),
    }
    v = dashboard(_one_kind(m(spark, sf)), panels, grid(spark, sf), RANGE, node="h1|h2")
    return v.select("panel", "series_key", epoch().alias("t"), r("value", 9).alias("value"))


# --- stored tables -------------------------------------------------------------------------------


@query(
    "sample_store",
    f"""with {M} select metric, host, count(*) as n, round(sum(value), 4) as total from m where metric in ('click', 'error') and ts > timestamp '2024-01-10' and ts <= timestamp '2024-01-20 12:00:00' group by 1, 2""",
)
def sample_store(spark, sf):
    """Samples written by (date, metric) with a promoted label, then read for a range and two metrics."""
    path = shared_dir(spark, "samples")
    smp.write_samples(_labelled(m(spark, sf)), path, ["host"])
    s = smp.read_samples(spark, path, "2024-01-10 00:00:00", "2024-01-20 12:00:00", ["click", "error"])
    return s.groupBy("metric", "host").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query(
    "report_files",
    """select event_type as db, strftime(ts, '%Y-%m-%d') as day, count(*) as lines, round(sum(value), 4) as total_ms from events group by 1, 2""",
)
def report_files(spark, sf):
    """Log reports written to one folder per (database, day) and read back."""
    path = shared_dir(spark, "reports")
    logs.write_report(logs.report(logs.select(logs.parse(log_lines(spark, sf)))), path)
    rep = spark.read.parquet(path)
    return rep.groupBy("db", F.date_format("report_date", "yyyy-MM-dd").alias("day")).agg(F.sum("lines").alias("lines"), r(F.sum("total_ms"), 4).alias("total_ms"))


@query(
    "archive_files",
    """select o_orderstatus as db, case when o_orderdate < (select max(o_orderdate) from orders) - interval 30 day then 'archive' else 'kept' end as place, count(*) as n, max(strftime(o_orderdate, '%Y')) as last_year from orders group by 1, 2""",
)
def archive_files(spark, sf):
    path = shared_dir(spark, "archive")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("db"), "o_orderdate")
    kept = logs.archive(o, "o_orderdate", o.agg(F.max("o_orderdate")).scalar(), path)
    old = logs.read_archive(spark, path)
    both = kept.select("db", F.lit("kept").alias("place"), "o_orderdate").unionByName(old.select("db", F.lit("archive").alias("place"), "o_orderdate"))
    return both.groupBy("db", "place").agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy").alias("last_year"))


@query(
    "archive_two_runs",
    """with x as (select o_orderstatus as db, strftime(o_orderdate, '%Y-%m') as month, o_orderdate < (select max(o_orderdate) from orders) - interval 13 day as old from orders)
    select db, month, count(*) filter (old) as archived, count(*) filter (not old) as kept from x group by 1, 2""",
)
def archive_two_runs(spark, sf):
    """Two cut-offs ten days apart, the first run repeated: no row is lost or doubled."""
    path = shared_dir(spark, "archive")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("db"), "o_orderdate")
    newest = o.agg(F.max("o_orderdate")).scalar()
    early = newest - F.make_interval(days=F.lit(23))
    logs.archive(o, "o_orderdate", early, path, days=0)
    kept = logs.archive(o, "o_orderdate", early, path, days=0)
    kept = logs.archive(kept, "o_orderdate", newest - F.make_interval(days=F.lit(13)), path, days=0)
    both = kept.select("db", "o_orderdate", F.lit(0).alias("old")).unionByName(logs.read_archive(spark, path).select("db", "o_orderdate", F.lit(1).alias("old")))
    return both.groupBy("db", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("old").alias("archived"), F.sum(1 - F.col("old")).alias("kept"))


@query(
    "log_multiline",
    """with d as (select cast(make_timestamp((min(epoch_us(ts)) + max(epoch_us(ts))) // 2) as date) as day from events)
    select cast(user_id % 3 as varchar) as shape, count(*) as lines, round(sum(value), 4) as total_ms, 0 as other_days from events, d where cast(ts as date) = day and event_type <> 'error' group by 1""",
)
def log_multiline(spark, sf):
    """Log files of every day, whose statements run over several lines; those of the day in the middle of
    the table are read back as whole records, and no record of another day."""
    path = shared_dir(spark, "logs")
    e = table(spark, sf, "events")
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC [10.0.0.1(5432)] [7]: [1-1] user=u,db="), F.col("event_type"), F.lit(",e=00000 LOG:  duration: "), F.col("value").cast("string"),
        F.lit(" ms  statement: select a\n\tfrom t\nwhere x = "), (F.col("user_id") % 3).cast("string"), F.lit(" and y = 'b'"),
    )
    e.select(text.alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("log_day")).repartition("log_day").write.partitionBy("log_day").text(path)
    lo, hi = (u or 0 for u in bounds(spark, sf))
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=(lo + hi) // 2)).strftime("%Y-%m-%d")
    log = logs.select(logs.parse(logs.read_day(spark, f"{path}/log_day={day}", day, pattern="part-*")), exclude_db=["error"])
    shape = F.regexp_extract(logs.statement(F.col("message")), r"(?s)^select a\s+from t\s+where x = (\d)", 1)
    others = F.count_if(~F.col("log_time").cast("string").startswith(day)).cast("int")
    return log.groupBy(shape.alias("shape")).agg(F.count("*").alias("lines"), r(F.sum(logs.duration_ms(F.col("message"))), 4).alias("total_ms"), others.alias("other_days"))


@query("refresh_files", f"with {M} select strftime(ts, '%Y-%m-%d') as day, metric, count(*) as n, round(sum(value), 4) as total from m group by 1, 2")
def refresh_files(spark, sf):
    """A stored result brought up to date by replacing only the partitions that changed."""
    path = shared_dir(spark, "metric-view")
    s = m(spark, sf).withColumn("day", F.concat(F.lit("d"), F.date_format("ts", "yyyy-MM-dd")))

    def compute(x):
        return x.groupBy("day", "metric").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))

    early = s.where("ts < timestamp'2024-01-20 12:00:00'")
    refresh.refresh_partitions(spark, early, path, "day", early.select("day"), compute)
    refresh.refresh_partitions(spark, s, path, "day", s.where("ts >= timestamp'2024-01-20 12:00:00'").select("day"), compute)
    return spark.read.parquet(path).withColumn("day", F.substring("day", 2, 10)).select("day", "metric", "n", "total")
