"""Alert rules, states, inhibition, routing, grouping, notifications (AL1-AL15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..alerts import routing as R
from ..alerts import state as S
from ..alerts.evaluate import evaluate
from ..alerts.rules import Rule
from ..operators import windows as W
from ..operators.series import dictionary
from .registry import DAILY, M, day_grid, epoch, m, query, r

_METRICS = ("click", "view", "error", "purchase", "signup")
_DAY = 86400


def _rules():
    """Two tiers for each metric; errors and sign-ups belong to another service."""
    out = []
    for name in _METRICS:
        service = "system" if name in ("error", "signup") else "postgresql"
        for severity, threshold, hold in (("warning", 49.0, 2 * _DAY), ("critical", 52.0, _DAY)):
            out.append(Rule(f"High_{name}", "instant", name, ">", threshold, hold, severity, service))
    return out


def _daily(spark, sf, grid):
    """Daily averages as samples of their own."""
    v = W.over_time(m(spark, sf), grid, "1d", ["avg"], ["metric", "host"])
    return v.select("metric", _labels().alias("labels"), F.col("t").alias("ts"), F.col("avg").alias("value"))


def _labels():
    return F.create_map(F.lit("host"), F.col("host"), F.lit("job"), F.concat(F.lit("j"), F.substring("host", 2, 1)))


def _hits_on(spark, sf, grid):
    # the dictionary needs no averages, so it is taken from the samples before them
    known = dictionary(m(spark, sf).select("metric", "host").distinct().select("metric", _labels().alias("labels")))
    return evaluate(_daily(spark, sf, grid), _rules(), grid, "1d", known)


def _hits(spark, sf):
    return _hits_on(spark, sf, day_grid(spark, sf))


def _states(spark, sf, grid=None):
    grid = grid or day_grid(spark, sf)
    return S.alert_states(_hits_on(spark, sf, grid), grid)


_H = f"""{M}, {DAILY}, d as (select metric, host, t, avg(value) as v from g join m on ts > t - interval 1 day and ts <= t group by 1, 2, 3),
  rules as (select x.metric, case when x.metric in ('error', 'signup') then 'system' else 'postgresql' end as service, y.severity, y.threshold, y.hold
    from (values ('click'), ('view'), ('error'), ('purchase'), ('signup')) x(metric), (values ('warning', 49.0, 2), ('critical', 52.0, 1)) y(severity, threshold, hold)),
  h as (select concat('High_', metric) as alertname, severity, service, hold, metric, host, concat('j', host[2:2]) as job, t, v as value from d join rules using (metric) where v > threshold)"""
_S = (
    _H
    + """, i as (select *, t - row_number() over (partition by alertname, severity, host order by t) * interval 1 day as run from h),
  s as (select *, min(t) over (partition by alertname, severity, host, run) as since from i),
  st as (select *, case when t - since >= hold * interval 1 day then 'firing' else 'pending' end as alertstate from s)"""
)


@query(
    "alert_rules",
    f"with {_H} select alertname, severity, service, host, cast(epoch(t) as bigint) as t, round(value, 6) as value from h",
)
def alert_rules(spark, sf):
    h = _hits(spark, sf)
    return h.select("alertname", "severity", "service", F.col("labels")["host"].alias("host"), epoch().alias("t"), r("value", 6).alias("value"))


@query(
    "alert_state",
    f"with {_S} select alertname, severity, host, cast(epoch(t) as bigint) as t, cast(epoch(since) as bigint) as active_since, alertstate from st",
)
def alert_state(spark, sf):
    """Samples to daily averages, two-tier rules, pending and firing states: the flagship path."""
    s = _states(spark, sf)
    return s.select("alertname", "severity", F.col("labels")["host"].alias("host"), epoch().alias("t"), epoch("active_since").alias("active_since"), "alertstate")


@query(
    "inhibit",
    f"""with {_S} select alertname, severity, host, cast(epoch(t) as bigint) as t from st a where alertstate = 'firing' and not (severity = 'warning' and exists
    (select 1 from st b where b.alertstate = 'firing' and b.severity = 'critical' and b.alertname = a.alertname and b.job = a.job and b.service = a.service and b.t = a.t))""",
)
def inhibit(spark, sf):
    firing = _states(spark, sf).where("alertstate = 'firing'")
    return R.inhibit(firing).select("alertname", "severity", F.col("labels")["host"].alias("host"), epoch().alias("t"))


_TREE = R.Route(
    R.DEFAULT_RECEIVER,
    routes=(
        R.Route("night-desk", match={"severity": "critical"}),
        R.Route("ticket-queue", match_re={"alertname": ".*(Click|View).*", "service": "post.+"}),
        R.Route("mailing-list", match_re={"service": "post.+|sys.+"}),
    ),
)


@query(
    "route",
    f"""with {_S} select case when severity = 'critical' then 'night-desk' when regexp_full_match(alertname, '.*(Click|View).*') and regexp_full_match(service, 'post.+') then 'ticket-queue'
    when regexp_full_match(service, 'post.+|sys.+') then 'mailing-list' else 'default-receiver' end as receiver, alertname, count(*) as n
    from st where alertstate = 'firing' group by 1, 2""",
)
def route(spark, sf):
    firing = _states(spark, sf).where("alertstate = 'firing'")
    return R.route(firing, _TREE).groupBy("receiver", "alertname").agg(F.count("*").alias("n"))


@query(
    "route_parts",
    """select case when p_type = 'ECONOMY' and p_size > 25 then 'big-economy' when regexp_full_match(p_type, 'ECO.*|SMALL') then 'cheap'
    when p_brand = 'Brand#7' then 'brand7' else 'default-receiver' end as receiver, count(*) as n from part group by 1""",
)
def route_parts(spark, sf):
    """First match on each level over a large set of labelled objects."""
    from ..sources.tables import table

    p = table(spark, sf, "part").withColumn("size_class", F.when(F.col("p_size") > 25, "big").otherwise("small"))
    tree = R.Route(
        R.DEFAULT_RECEIVER,
        routes=(
            R.Route("cheap", match_re={"p_type": "ECO.*|SMALL"}, routes=(R.Route("big-economy", match={"size_class": "big", "p_type": "ECONOMY"}),)),
            R.Route("brand7", match={"p_brand": "Brand#7"}),
        ),
    )
    return R.route(p, tree).groupBy("receiver").agg(F.count("*").alias("n"))


@query(
    "group_alerts",
    f"""with {_S} select severity, service, job, alertname, cast(epoch(t) as bigint) as t, count(*) as alerts, min(host) as first_member, max(host) as last_member, round(max(value), 6) as top
    from st where alertstate = 'firing' group by 1, 2, 3, 4, t""",
)
def group_alerts(spark, sf):
    firing = _states(spark, sf).where("alertstate = 'firing'")
    g = R.group_alerts(firing.withColumn("series_key", F.col("labels")["host"]))
    return g.select("severity", "service", "job", "alertname", epoch().alias("t"), "alerts", "first_member", "last_member", r("top", 6).alias("top"))


@query(
    "notifications",
    f"""with recursive {_S}, f as (select distinct alertname, severity, host, t from st where alertstate = 'firing'),
  n as (select severity, alertname, t, count(*) as c, count(*) filter (not exists (select 1 from f p where p.alertname = f.alertname and p.severity = f.severity and p.host = f.host and p.t = f.t - interval 1 day)) as new from f group by 1, 2, 3),
  e as (select severity, alertname, t + interval 1 day as t, count(*) as resolved from f where t < (select max(t) from g) and not exists
    (select 1 from f q where q.alertname = f.alertname and q.severity = f.severity and q.host = f.host and q.t = f.t + interval 1 day) group by 1, 2, 3),
  ch as (select coalesce(n.severity, e.severity) as severity, coalesce(n.alertname, e.alertname) as alertname, coalesce(n.t, e.t) as t, coalesce(n.c, 0) as firing, coalesce(n.new, 0) as new,
    coalesce(e.resolved, 0) as resolved from n full join e on n.severity = e.severity and n.alertname = e.alertname and n.t = e.t),
  x as (select *, row_number() over (partition by severity, alertname order by t) as i from ch),
  lastc as (select x.*, (select max(y.t) from x y where y.severity = x.severity and y.alertname = x.alertname and y.t <= x.t and y.new + y.resolved > 0) as lc from x)
  select severity, alertname, cast(epoch(t) as bigint) as sent_at, case when new + resolved > 0 then 'change' else 'repeat' end as reason, cast(firing as bigint) as firing,
    cast(new as bigint) as new, cast(resolved as bigint) as resolved from lastc where new + resolved > 0 or (epoch(t - lc) / 86400) % 2 = 0""",
)
def notifications(spark, sf):
    """Flushes on the evaluation days, repeated every second day while nothing changes."""
    grid = day_grid(spark, sf)
    stretches = S.transitions(_states(spark, sf, grid), grid)
    out = R.notifications(stretches, ["severity", "alertname"], wait="0s", interval="1d", repeat="2d", until=F.timestamp_micros(F.lit(grid.end)))
    return out.select("severity", "alertname", epoch("sent_at").alias("sent_at"), "reason", "firing", "new", "resolved")


@query(
    "alert_history",
    f"""with {_S} select alertstate, severity, count(*) as n, count(distinct concat(alertname, host)) as alerts from st
    where t > (select max(t) from g) - interval 7 day group by 1, 2""",
)
def alert_history(spark, sf):
    grid = day_grid(spark, sf)
    h = S.history(_states(spark, sf, grid), F.timestamp_micros(F.lit(grid.end)), 7, None)
    per = h.groupBy("alertstate", "severity", "alertname", "series_key").agg(F.count("*").alias("n"))
    return per.groupBy("alertstate", "severity").agg(F.sum("n").alias("n"), F.count("*").alias("alerts"))


@query(
    "severity_counts",
    f"""with {_S} select s.severity, count(st.alertname) as count from (values ('critical'), ('warning'), ('info')) s(severity)
    left join (select * from st where alertstate = 'firing' and t = (select max(t) - interval 1 day from g)) st on st.severity = s.severity group by 1""",
)
def severity_counts(spark, sf):
    """Counts on the last but one day."""
    grid = day_grid(spark, sf)
    return S.severity_counts(_states(spark, sf, grid).where(F.col("t") == F.timestamp_micros(F.lit(grid.end - grid.step))))


@query(
    "alert_texts",
    f"""with {_S} select alertname, severity, host, cast(epoch(t) as bigint) as t, concat(job, ' (instance: ): ', alertname, ', severity ', severity) as summary from st where alertstate = 'firing'""",
)
def alert_texts(spark, sf):
    firing = _states(spark, sf).where("alertstate = 'firing'")
    text = F.lit("{{ $labels.job }} (instance: {{ $labels.instance }}): {{ $labels.alertname }}, severity {{ $labels.severity }}")
    a = S.annotate(firing.withColumn("summary", text))
    return a.select("alertname", "severity", F.col("labels")["host"].alias("host"), epoch().alias("t"), "summary")


@query(
    "alert_series",
    f"""with {_S} select alertname, alertstate, severity, host, count(*) as n, cast(sum(1.0) as double) as total from st group by 1, 2, 3, 4""",
)
def alert_series(spark, sf):
    a = S.alert_series(_states(spark, sf))
    lab = F.col("labels")
    return a.groupBy(*[lab[c].alias(c) for c in ("alertname", "alertstate", "severity", "host")]).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# --- rule families over the daily averages ------------------------------------------------------


def _family(spark, sf, *rules):
    grid = day_grid(spark, sf)
    h = evaluate(_daily(spark, sf, grid), rules, grid, "1d")
    return h.select("alertname", "severity", "series_key", epoch().alias("t"), r("value", 6).alias("value"))


_D = f"""{M}, {DAILY}, d as (select metric, host, t, avg(value) as v from g join m on ts > t - interval 1 day and ts <= t group by 1, 2, 3),
  w as (select host, concat('{{"host":"', host, '","job":"j', host[2:2], '"}}') as series_key, t, max(case when metric = 'click' then v end) as a, max(case when metric = 'view' then v end) as b from d group by 1, 2, 3)"""


@query(
    "rule_ratio",
    f"""with {_D} select 'Ratio' as alertname, x.severity, series_key, cast(epoch(t) as bigint) as t, round(100 * (a / b), 6) as value from w, (values ('warning', 95.0), ('critical', 120.0)) x(severity, lim) where 100 * (a / b) > lim
    union all select 'Free', 'warning', series_key, cast(epoch(t) as bigint), round(100 - 100 * (a / b), 6) from w where 100 - 100 * (a / b) > 20""",
)
def rule_ratio(spark, sf):
    return _family(
        spark, sf, Rule("Ratio", "ratio_pct", "click", ">", 95, 0, "warning", metric2="view"), Rule("Ratio", "ratio_pct", "click", ">", 120, 0, metric2="view"),
        Rule("Free", "free_pct", "click", ">", 20, 0, "warning", metric2="view"),
    )


@query(
    "rule_cluster",
    f"""with {_D}, k as (select t, max(a) as top, count(a) as n, max(b) as topb from w group by t)
    select 'Top' as alertname, 'critical' as severity, '{{}}' as series_key, cast(epoch(t) as bigint) as t, round(top, 6) as value from k where top < 60
    union all select 'Few', 'critical', '{{}}', cast(epoch(t) as bigint), n::double from k where n < 5
    union all select 'Odd', 'critical', '{{}}', cast(epoch(t) as bigint), (n % 2)::double from k where n % 2 <> 1
    union all select 'Both', 'critical', '{{}}', cast(epoch(t) as bigint), round(greatest(top, topb), 6) from k where greatest(top, topb) < 62
    union all select 'PerHost', 'critical', concat('{{"host":"', host, '"}}'), cast(epoch(t) as bigint), round(a, 6) from w where a < 45""",
)
def rule_cluster(spark, sf):
    return _family(
        spark, sf, Rule("Top", "max_by", "click", "<", 60, 0), Rule("Few", "count_by", "click", "<", 5, 0), Rule("Odd", "odd_count", "click", "!=", 1, 0),
        Rule("Both", "max_both", "click", "<", 62, 0, metric2="view"), Rule("PerHost", "max_by", "click", "<", 45, 0, by=("host",)),
    )


@query(
    "rule_and_sum",
    f"""with {_D} select 'Guarded' as alertname, 'critical' as severity, concat('{{"host":"', host, '"}}') as series_key, cast(epoch(t) as bigint) as t, round(b, 6) as value from w where a >= 50 and b > 48
    union all select 'SumFree', 'critical', '{{}}', cast(epoch(t) as bigint), round(100 - 100 * sum(a / b), 6) from w group by t having 100 - 100 * sum(a / b) < -300""",
)
def rule_and_sum(spark, sf):
    return _family(
        spark, sf, Rule("Guarded", "and_min", "click", ">", 48, 0, metric2="view", minimum=50, by=("host",)),
        Rule("SumFree", "sum_free_pct", "click", "<", -300, 0, metric2="view"),
    )


@query(
    "rule_offset",
    f"""with {_D}, p as (select x.host, x.series_key, x.t, floor(x.a / 10) as v, floor(y.a / 10) as o from w x join w y on x.host = y.host and y.t = x.t - interval 1 day)
    select 'Switch' as alertname, 'critical' as severity, series_key, cast(epoch(t) as bigint) as t, v::double as value from p where v <> o
    union all select 'Jump', 'critical', series_key, cast(epoch(t) as bigint), (v - o)::double from p where v - o > 1
    union all select 'RoleChange', 'critical', concat('{{"job":"j', host[2:2], '"}}'), cast(epoch(t) as bigint), count(*)::double from p where v <> o group by host, t having count(*) >= 1""",
)
def rule_offset(spark, sf):
    grid = day_grid(spark, sf)
    d = _daily(spark, sf, grid).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    rules = [
        Rule("Switch", "changed", "click", "any", 0, 0, window="1d"), Rule("Jump", "delta", "click", ">", 1, 0, window="1d"),
        Rule("RoleChange", "role_change", "click", ">=", 1, 0, by=("job",), window="1d", extra={"ignoring": ("host",)}),
    ]
    h = evaluate(d, rules, grid, "1d")
    return h.select("alertname", "severity", "series_key", epoch().alias("t"), "value")


@query(
    "rule_ranges",
    f"""with {_D}, a3 as (select x.series_key, x.t, avg(y.a) as v, sum(case when y.p is not null and y.a <> y.p and y.t > x.t - interval 2 day then 1 else 0 end) as ch,
    regr_intercept(y.a, epoch(y.t - x.t)) + regr_slope(y.a, epoch(y.t - x.t)) * 86400 as f, count(*) as n, max(case when y.t = x.t then y.a end) as la, max(case when y.t = x.t then y.b end) as lb
    from w x join (select *, lag(a) over (partition by host order by t) as p from w) y on x.host = y.host and y.t > x.t - interval 3 day and y.t <= x.t group by 1, 2)
    select 'LowAvg' as alertname, 'critical' as severity, series_key, cast(epoch(t) as bigint) as t, round(v, 6) as value from a3 where v < 48
    union all select 'Moves', 'warning', series_key, cast(epoch(t) as bigint), ch::double from a3 where ch <> 0
    union all select 'Forecast', 'warning', series_key, cast(epoch(t) as bigint), round(f, 6) from a3 where n >= 2 and f < 40 and 100 * ((lb - la) / lb) > 0""",
)
def rule_ranges(spark, sf):
    return _family(
        spark, sf, Rule("LowAvg", "avg_over_time", "click", "<", 48, 0, window="3d"), Rule("Moves", "changes", "click", "!=", 0, 0, "warning", window="3d"),
        Rule("Forecast", "forecast", "click", "<", 40, 0, "warning", metric2="view", minimum=0, window="3d", ahead="1d"),
    )


@query(
    "rule_absent",
    f"""with {DAILY} select 'Gone' as alertname, 'critical' as severity, '{{"host":"h9"}}' as series_key, cast(epoch(t) as bigint) as t, 1.0::double as value from g""",
)
def rule_absent(spark, sf):
    return _family(
        spark, sf, Rule("Gone", "absent", "click", "any", 0, 0, matchers=(("host", "=", "h9"),)), Rule("Here", "absent", "click", "any", 0, 0, matchers=(("host", "=~", "h[0-3]"),))
    )


@query(
    "rule_load",
    f"""with {M}, {DAILY}, d as (select metric, host, t, avg(value) as v from g join m on ts > t - interval 1 day and ts <= t group by 1, 2, 3),
    l as (select host, t, max(case when metric = 'click' then v end) as load, count(distinct metric) filter (metric <> 'click') as cores from d group by 1, 2)
    select concat('{{"host":"', host, '"}}') as series_key, cast(epoch(t) as bigint) as t, round(load, 6) as value from l where load / cores > 13""",
)
def rule_load(spark, sf):
    grid = day_grid(spark, sf)
    d = _daily(spark, sf, grid)
    host = F.col("labels")["host"]
    load = d.where("metric = 'click'").select(F.lit("load5").alias("metric"), F.create_map(F.lit("host"), host).alias("labels"), "ts", "value")
    cpu = d.where("metric <> 'click'").select(
        F.lit("cpu_seconds").alias("metric"), F.create_map(F.lit("host"), host, F.lit("cpu"), F.col("metric"), F.lit("mode"), F.lit("idle")).alias("labels"), "ts", "value"
    )
    rule = Rule("Load", "load", "load5", ">", 13, 0, metric2="cpu_seconds", by=("cpu", "mode"))
    h = evaluate(load.unionByName(cpu), [rule], grid, "1d")
    return h.select("series_key", epoch().alias("t"), r("value", 6).alias("value"))
