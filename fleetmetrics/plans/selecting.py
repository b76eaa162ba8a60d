"""Sources, sinks, relabelling and selectors (SRC*, SNK2, SNK3, SEL*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import to_samples
from ..operators import aggregate as A
from ..operators import selectors as S
from ..sources import exposition, json_reports, logs, samples as smp
from ..sources.tables import as_labelled, table
from .registry import M, m, query, r

_AGG = "count(*) as n, round(sum(value), 4) as total"


def _summary(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query(
    "samples_unpivot",
    """with a as (select l_returnflag as flag, l_linestatus as status, sum(l_quantity) as quantity, sum(l_tax) as tax, sum(l_discount) as discount
    from lineitem group by 1, 2) select concat('line_', name) as metric, flag, status, round(value, 4) as value
    from (unpivot a on quantity, tax, discount into name name value value)""",
)
def samples_unpivot(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax"), F.sum("l_discount").alias("discount"), F.max("l_shipdate").alias("snapshot_ts")
    )
    s = to_samples(wide, "line", ["quantity", "tax", "discount"], ["flag", "status"])
    return s.select("metric", F.col("labels")["flag"].alias("flag"), F.col("labels")["status"].alias("status"), r("value", 4).alias("value"))


@query(
    "target_labels",
    """select n_name as instance, r_name as cluster_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders
    join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
)
def target_labels(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("value"))
    # fold to one row for each customer before any join
    per_customer = orders.groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    targets = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("instance"), F.col("r_name").alias("cluster_name"))
    s = smp.add_target_labels(per_customer.join(table(spark, sf, "customer"), "c_custkey"), targets, ["c_nationkey"], into_map=False)
    return s.groupBy("instance", "cluster_name").agg(F.sum("n").alias("n"), r(F.sum("total"), 2).alias("total"))


@query("relabel_drop", f"with {M} select metric, {_AGG} from m where not regexp_full_match(metric, '(sign.*|err.*)') group by metric")
def relabel_drop(spark, sf):
    return _summary(smp.drop_metrics(m(spark, sf), "(sign.*|err.*)"), "metric")


@query(
    "relabel_replace",
    f"""with {M} select metric, case when regexp_full_match(concat(metric, ';', host), 'c.*;.+') then '' else host end as host, {_AGG} from m group by 1, 2""",
)
def relabel_replace(spark, sf):
    return _summary(smp.replace_label(m(spark, sf), ["__name__", "host"], "c.*;.+", "host", ""), "metric", "host")


@query("relabel_keep_join", f"with {M} select concat_ws(':', metric, host) as pg_cluster, {_AGG} from m where host = 'h1' group by 1")
def relabel_keep_join(spark, sf):
    kept = smp.keep_where(m(spark, sf), "host", "h1")
    return _summary(smp.join_labels(kept, ["metric", "host"], "pg_cluster"), "pg_cluster")


@query("exposition_parse", f"with {M} select metric, host, count(*) as n, round(sum(value), 4) as total, max(value) as top from m group by 1, 2")
def exposition_parse(spark, sf):
    line = exposition.render(F.col("metric"), [("host", F.col("host"))], F.col("value"))
    s = exposition.parse(m(spark, sf).select(line.alias("raw"), "ts"), scraped_at=F.col("ts"))
    flat = s.select("metric", F.col("labels")["host"].alias("host"), "value")
    return flat.groupBy("metric", "host").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"), F.max("value").alias("top"))


@query(
    "json_props",
    """select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k_sum,
    max(cast(json_extract_string(props, '$.k') as bigint)) as k_max from events group by 1""",
)
def json_props(spark, sf):
    k = json_reports.json_number(F.col("props"), "$.k")
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max")
    )


@query(
    "json_report_lines",
    """select concat('etc_', event_type, '.conf') as config_file, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k_sum
    from events where props like '%"k": 6%' group by 1""",
)
def json_report_lines(spark, sf):
    lines = table(spark, sf, "events").select(F.concat(F.lit("etc/"), F.col("event_type"), F.lit(".conf|"), F.col("props")).alias("raw"))
    reports = json_reports.split_reports(lines, '"k": 6')
    return reports.groupBy("config_file").agg(F.count("*").alias("n"), F.sum(json_reports.json_number(F.col("data"), "$.k")).alias("k_sum"))


def log_lines(spark, sf):
    """Server log lines made from the events, in the default prefix."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC [10.0.0.1(5432)] ["), F.col("event_id").cast("string"), F.lit("]: [1-1] user=u"),
            F.pmod("user_id", F.lit(3)).cast("string"), F.lit(",db="), F.col("event_type"), F.lit(",e=00000 LOG:  duration: "), F.col("value").cast("string"),
            F.lit(" ms  statement: select "), F.col("user_id").cast("string"), F.lit(" from t"), F.pmod("user_id", F.lit(2)).cast("string"),
        ).alias("raw")
    )


@query(
    "log_parse_report",
    """select event_type as db, strftime(ts, '%Y-%m-%d') as day, concat('u', cast(user_id % 3 as varchar)) as user_name,
    concat('select ? from t', cast(user_id % 2 as varchar)) as statement, count(*) as lines, round(sum(value), 4) as total_ms, max(value) as max_ms
    from events where event_type <> 'error' and not regexp_matches(concat('select ', cast(user_id as varchar), ' from t'), '^select 1') group by 1, 2, 3, 4""",
)
def log_parse_report(spark, sf):
    log = logs.select(logs.parse(log_lines(spark, sf)), exclude_db=["error"], exclude_query="^select 1")
    rep = logs.report(log)
    return rep.select(
        "db", F.date_format("report_date", "yyyy-MM-dd").alias("day"), "user_name", "statement", "lines", r("total_ms", 4).alias("total_ms"), "max_ms"
    )


@query(
    "log_day",
    """select event_type as db, count(*) as lines, round(sum(value), 4) as total_ms from events
    where cast(ts as date) = date '2024-01-15' and event_type <> 'error' group by 1""",
)
def log_day(spark, sf):
    log = logs.select(logs.parse(log_lines(spark, sf)), day="2024-01-15", exclude_db=["error"])
    ms = logs.duration_ms(F.col("message"))
    return log.groupBy("db").agg(F.count("*").alias("lines"), r(F.sum(ms), 4).alias("total_ms"))


@query(
    "archive_plan",
    """select strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%m') as month, count(*) as n from orders
    where o_orderdate < (select max(o_orderdate) from orders) - interval 30 day group by 1, 2""",
)
def archive_plan(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderdate")
    marked = logs.split_by_age(orders, "o_orderdate", orders.agg(F.max("o_orderdate")).scalar(), 30)
    return marked.where("archived").groupBy("year", "month").agg(F.count("*").alias("n"))


@query("retention_7d", f"with {M} select metric, {_AGG} from m where ts >= (select max(ts) from m) - interval 7 day group by 1")
def retention_7d(spark, sf):
    return _summary(smp.retain(m(spark, sf), 7), "metric")


@query("sel_eq", f"with {M} select host, {_AGG} from m where metric = 'click' group by 1")
def sel_eq(spark, sf):
    return _summary(S.select(m(spark, sf), "click"), "host")


@query("sel_ne", f"with {M} select metric, {_AGG} from m where host <> 'h1' group by 1")
def sel_ne(spark, sf):
    return _summary(S.select(m(spark, sf), None, [("host", "!=", "h1")]), "metric")


@query("sel_re", f"with {M} select metric, {_AGG} from m where regexp_full_match(metric, 'cl|.*urch.*|vie') and regexp_full_match(host, 'h[0-2]') group by 1")
def sel_re(spark, sf):
    return _summary(S.select(m(spark, sf), None, [("metric", "=~", "cl|.*urch.*|vie"), ("host", "=~", "h[0-2]")]), "metric")


@query("sel_nre", f"with {M} select metric, host, {_AGG} from m where not regexp_full_match(metric, 'click|view') and not regexp_full_match(host, 'h[13]') group by 1, 2")
def sel_nre(spark, sf):
    return _summary(S.select(m(spark, sf), None, [("metric", "!~", "click|view"), ("host", "!~", "h[13]")]), "metric", "host")


@query("sel_map_label", f"with {M} select metric, {_AGG} from m where host <> 'h1' group by 1")
def sel_map_label(spark, sf):
    """Labels in the map; a label that does not exist reads as ''."""
    lab = as_labelled(m(spark, sf))
    return _summary(S.select(lab, None, [("host", "!=", "h1"), ("pool", "=", "")]), "metric")


@query("probe_down", f"with {M} select host, metric, count(*) as failed from m where not (value > 10) group by 1, 2")
def probe_down(spark, sf):
    probe = m(spark, sf).withColumn("value", F.when(F.col("value") > 10, 1.0).otherwise(0.0))
    return S.filter_value(probe, "==", 0.0).groupBy("host", "metric").agg(F.count("*").alias("failed"))


@query(
    "threshold_filter",
    f"""with {M}, d as (select series_key, cast(ts as date) as day, avg(value) as v from m group by 1, 2)
    select series_key, strftime(day, '%Y-%m-%d') as day, round(v, 6) as value, round(100 - v, 6) as headroom from d where v > 50""",
)
def threshold_filter(spark, sf):
    d = m(spark, sf).groupBy("series_key", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"))
    return S.filter_value(d, ">", 50, "v").select("series_key", "day", r("v").alias("value"), r(100 - F.col("v")).alias("headroom"))


@query(
    "age_of_last",
    f"""with {M} select series_key, round(epoch_us((select max(ts) from m) - max(ts)) / 1e6, 6) as age from m group by 1""",
)
def age_of_last(spark, sf):
    s = m(spark, sf)
    now = s.agg(F.max("ts")).scalar()
    last = s.groupBy("series_key").agg(F.max("ts").alias("last"))
    return last.select("series_key", r(S.age_seconds(now, F.col("last"))).alias("age"))


@query("clamp", f"with {M} select host, round(sum(greatest(value - 50, 0)), 4) as low, round(sum(least(value, 1)), 4) as high from m group by 1")
def clamp(spark, sf):
    s = m(spark, sf).select("host", S.clamp_min(F.col("value") - 50, 0).alias("low"), S.clamp_max(F.col("value"), 1).alias("high"))
    return s.groupBy("host").agg(r(F.sum("low"), 4).alias("low"), r(F.sum("high"), 4).alias("high"))


@query("status_encode", "select case when o_orderstatus = 'F' then 1 else 2 end as code, cast(sum(cast(o_orderstatus = 'O' as int)) as bigint) as open, count(*) as n from orders group by 1")
def status_encode(spark, sf):
    code = S.encode(F.col("o_orderstatus"), {"F": 1}, 2)
    opened = (F.col("o_orderstatus") == "O").cast("int")
    return table(spark, sf, "orders").groupBy(code.alias("code")).agg(F.sum(opened).alias("open"), F.count("*").alias("n"))


@query(
    "null_normalise",
    """with u as (select user_id, max(case when event_type = 'error' then ts end) as f, max(case when event_type = 'purchase' then ts end) as a from events group by 1)
    select user_id, round(case when f is null or a is null then 0 when epoch_us(f - a) < 0 then 0 else epoch_us(f - a) / 1e6 end, 6) as gap from u""",
)
def null_normalise(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("f"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("a")
    )
    return u.select("user_id", r(S.non_negative(S.age_seconds(F.col("f"), F.col("a")))).alias("gap"))


@query("prefix_in_list", "select p_brand, count(*) as n from part where p_name like 'small%' or p_brand in ('Brand#1', 'Brand#2') group by 1")
def prefix_in_list(spark, sf):
    p = table(spark, sf, "part").where(F.col("p_name").like("small%") | F.col("p_brand").isin("Brand#1", "Brand#2"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "overdue",
    """with l as (select o_custkey, max(o_orderdate) as last from orders group by 1)
    select c_mktsegment, count(*) as overdue, count(*) - count(last) as never from customer left join l on c_custkey = o_custkey
    where last is null or last < (select max(o_orderdate) from orders) - interval 120 day group by 1""",
)
def overdue(spark, sf):
    orders = table(spark, sf, "orders")
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    as_of = orders.agg(F.max("o_orderdate")).scalar()
    due = table(spark, sf, "customer").join(last, "c_custkey", "left").where(S.overdue(F.col("last"), F.make_interval(days=F.lit(120)), as_of))
    return due.groupBy("c_mktsegment").agg(F.count("*").alias("overdue"), (F.count("*") - F.count("last")).alias("never"))


@query("label_values", "select distinct event_type as metric from events")
def label_values(spark, sf):
    return A.label_values(m(spark, sf), "metric")


@query("label_values_chained", f"with {M} select distinct host from m where metric = 'click' and value > 90")
def label_values_chained(spark, sf):
    return A.label_values(S.select(m(spark, sf), "click").where("value > 90"), "host")


_ODD = f"{M}, o as (select metric, host, event_id, case when event_id % 7 = 0 then 'nan'::double else value end as value, case when event_id % 5 = 0 then 0.0 else value end as other from m)"


def _odd(spark, sf):
    """Events with NaN in one column and zero in another."""
    s = m(spark, sf)
    return s.select("metric", "host", "event_id", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("value"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")).alias("other"))


@query("nan_compare", f"""with {_ODD} select metric, count(*) filter (not isnan(value) and value > 50) as above, count(*) filter (not isnan(value) and value <= 50) as upto,
    count(*) filter (isnan(value) or value <> 50) as differs, count(*) filter (not isnan(value) and value = value) as same from o group by 1""")
def nan_compare(spark, sf):
    """NaN is neither above nor below anything, equals nothing and differs from everything."""
    v, n = F.col("value"), F.count_if
    return _odd(spark, sf).groupBy("metric").agg(
        n(S.compare(v, ">", 50.0)).alias("above"), n(S.compare(v, "<=", 50.0)).alias("upto"), n(S.compare(v, "!=", 50.0)).alias("differs"), n(S.compare(v, "==", v)).alias("same")
    )


@query("max_nan", f"""with {_ODD} select host, coalesce(max(value) filter (not isnan(value)), 'nan'::double) as max, min(value) filter (not isnan(value)) as min from o where metric <> 'error' or event_id % 7 = 0 group by 1""")
def max_nan(spark, sf):
    from ..operators.aggregate import agg_by

    return agg_by(_odd(spark, sf).where("metric <> 'error' or event_id % 7 = 0"), ["host"], ["max", "min"])


@query("div_zero_rule", f"""with {_ODD}, d as (select metric, value, other, case when isnan(value) then 'nan'::double when other <> 0 then 100 * value / other when value = 0 then 'nan'::double else 'inf'::double end as q from o)
    select metric, count(*) filter (not isnan(q) and q > 90) as fires, count(*) filter (q = 'inf'::double) as infinite, count(*) filter (isnan(q)) as undefined from d group by 1""")
def div_zero_rule(spark, sf):
    """x/0 is infinite and lies above any threshold; 0/0 and NaN do not."""
    q = 100 * S.divide(F.col("value"), F.col("other"))
    return _odd(spark, sf).withColumn("q", q).groupBy("metric").agg(
        F.count_if(S.compare(F.col("q"), ">", 90.0)).alias("fires"), F.count_if(F.col("q") == float("inf")).alias("infinite"), F.count_if(F.isnan("q")).alias("undefined")
    )
