"""Aggregations, top-N, latest rows, report tables (AG*, W*, DS*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import aggregate as A
from ..operators import matching as J
from ..sources.tables import as_labelled, table
from .registry import M, m, query, r

_D = "strftime(ts, '%Y-%m-%d')"
_FIVE = "round(sum(value), 4) as sum, round(avg(value), 5) as avg, min(value) as min, max(value) as max, count(*) as count"


def _five(df):
    return df.withColumns({"sum": r("sum", 4), "avg": r("avg", 5)})


_FNS = ["sum", "avg", "min", "max", "count"]


@query("agg_by", f"with {M} select metric, {_FIVE} from m group by 1")
def agg_by(spark, sf):
    return _five(A.agg_by(m(spark, sf), ["metric"], _FNS))


@query("agg_by_missing", f"with {M} select '' as pool, host, {_FIVE} from m group by 1, 2")
def agg_by_missing(spark, sf):
    """A label no element carries groups everything under ''."""
    return _five(A.agg_by(as_labelled(m(spark, sf)), ["pool", "host"], _FNS))


@query("agg_without", f"with {M} select metric, {_FIVE} from m group by 1")
def agg_without(spark, sf):
    s = m(spark, sf)
    lab = s.select("value", F.create_map(F.lit("metric"), F.col("metric"), F.lit("host"), F.col("host")).alias("labels"))
    out = _five(A.agg_without(lab, ["host"], _FNS))
    return out.withColumn("metric", F.get_json_object("series_key", "$.metric")).drop("series_key")


@query("agg_global", f"with {M} select {_FIVE}, count(distinct host) % 2 = 1 as odd from m")
def agg_global(spark, sf):
    s = m(spark, sf)
    # fold to hosts first, then over all of them
    per = s.groupBy("host").agg(F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("c"))
    out = per.agg(
        F.sum("s").alias("sum"), (F.sum("s") / F.sum("c")).alias("avg"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.sum("c").alias("count"), (F.count("*") % 2 == 1).alias("odd"),
    )
    return _five(out)


@query("count_of_groups", f"with {M} select count(distinct metric) as groups from m")
def count_of_groups(spark, sf):
    return A.count_groups(m(spark, sf), ["metric"])


@query(
    "ratio_of_aggregates",
    f"""with {M} select host, round(sum(case when metric = 'error' then value end) / sum(case when metric = 'view' then value end) * 100, 5) as error_pct,
    round(100 - 100 * avg(case when metric = 'click' then value end) / avg(case when metric = 'view' then value end), 5) as free_pct from m group by 1""",
)
def ratio_of_aggregates(spark, sf):
    def of(metric):
        return F.when(F.col("metric") == metric, F.col("value"))

    return m(spark, sf).groupBy("host").agg(
        r(F.sum(of("error")) / F.sum(of("view")) * 100, 5).alias("error_pct"), r(100 - 100 * F.avg(of("click")) / F.avg(of("view")), 5).alias("free_pct")
    )


@query(
    "sum_of_ratios",
    f"""with {M}, d as (select {_D} as day, host, sum(case when metric = 'click' then value end) as a, sum(case when metric = 'view' then value end) as b from m group by 1, 2)
    select day, round(100 - 100 * sum(a / b), 5) as value from d where a is not null and b is not null and b <> 0 group by 1""",
)
def sum_of_ratios(spark, sf):
    d = m(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "metric", "host").agg(F.sum("value").alias("value"))
    ratio = J.pivot_metrics(d, ["click", "view"], ["day", "host"]).where("view <> 0").withColumn("value", F.col("click") / F.col("view"))
    return A.agg_by(ratio, ["day"], ["sum"]).select("day", r(100 - 100 * F.col("sum"), 5).alias("value"))


@query(
    "composite_state",
    """with s as (select o_custkey % 50 as cluster, count(*) * 100 + sum(case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end) as code from orders group by 1)
    select cluster, cast(code as double) as code, case when code <= 28000 then 'DOWN' when code <= 30500 then 'STANDALONE' else 'HA' end as state from s""",
)
def composite_state(spark, sf):
    role = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    s = table(spark, sf, "orders").groupBy(F.pmod("o_custkey", F.lit(50)).alias("cluster")).agg((F.count("*") * 100 + F.sum(role)).cast("double").alias("code"))
    bands = [(float("-inf"), 28000, "DOWN"), (28001, 30500, "STANDALONE"), (30501, float("inf"), "HA")]
    return s.withColumn("state", A.map_values(F.col("code"), ranges=bands, null_text="DOWN"))


@query(
    "state_counts",
    "select concat('h', cast(user_id % 4 as varchar)) as host, event_type as state, count(*) as count from events group by 1, 2",
)
def state_counts(spark, sf):
    return m(spark, sf).groupBy("host", F.col("metric").alias("state")).agg(F.count("*").alias("count"))


@query("top_n", "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_n(spark, sf):
    return A.top_n(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 20, ["o_orderkey"])


@query(
    "top_n_multi",
    """select l_partkey, sum(l_quantity) as records, count(*) as fpi, round(sum(l_extendedprice), 2) as bytes from lineitem group by 1 order by 4 desc, 1 limit 20""",
)
def top_n_multi(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("records"), F.count("*").alias("fpi"), r(F.sum("l_extendedprice"), 2).alias("bytes")
    )
    return A.top_n(t, "bytes", 20, ["l_partkey"])


@query(
    "grouped_top_n",
    """select o_custkey, o_orderpriority, max(o_totalprice) as top from orders group by 1, 2 order by 3 desc, 1, 2 limit 20""",
)
def grouped_top_n(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("top"))
    return A.top_n(g, "top", 20, ["o_custkey", "o_orderpriority"])


@query(
    "top_n_within",
    """select o_orderpriority, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) <= 5""",
)
def top_n_within(spark, sf):
    t = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return A.top_n(t, "o_totalprice", 5, ["o_orderkey"], ["o_orderpriority"])


@query("top_n_filtered", "select o_orderkey, o_totalprice from orders where o_totalprice > 10240 and o_orderstatus = 'O' order by 2 desc, 1 limit 20")
def top_n_filtered(spark, sf):
    t = table(spark, sf, "orders").where("o_totalprice > 10240 and o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return A.top_n(t, "o_totalprice", 20, ["o_orderkey"])


@query("latest_state", "select user_id, arg_max(event_type, ts) as event_type, arg_max(value, ts) as value from events group by 1")
def latest_state(spark, sf):
    return A.latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query(
    "ordered_hash",
    """select r_name, md5(string_agg(concat(n_name, cast(n_nationkey as varchar)), ',' order by n_name)) as hash from region join nation on r_regionkey = n_regionkey group by 1""",
)
def ordered_hash(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    entry = F.struct("n_name", F.concat("n_name", F.col("n_nationkey").cast("string")).alias("e"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]), ",")
    return j.groupBy("r_name").agg(F.md5(text).alias("hash"))


@query("epoch_min_max", "select user_id, cast(floor(epoch(min(ts))) as bigint) as first_s, cast(floor(epoch(max(ts))) as bigint) as last_s from events group by 1")
def epoch_min_max(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.unix_seconds(F.min("ts")).alias("first_s"), F.unix_seconds(F.max("ts")).alias("last_s"))


@query(
    "conditional_maxima",
    """select user_id, round(epoch_us((select max(ts) from events) - max(case when event_type in ('purchase') then ts end)) / 1e6, 6) as full_age,
    round(epoch_us((select max(ts) from events) - max(case when event_type in ('purchase', 'click') then ts end)) / 1e6, 6) as diff_age,
    round(epoch_us((select max(ts) from events) - max(case when event_type in ('purchase', 'click', 'view') then ts end)) / 1e6, 6) as incr_age from events group by 1""",
)
def conditional_maxima(spark, sf):
    """Three conditional maxima in one scan."""
    e = table(spark, sf, "events")
    now = F.unix_micros(e.agg(F.max("ts")).scalar())

    def last(*types):
        return F.max(F.when(F.col("event_type").isin(*types), F.unix_micros("ts")))

    out = e.groupBy("user_id").agg(last("purchase").alias("f"), last("purchase", "click").alias("d"), last("purchase", "click", "view").alias("i"))
    return out.select("user_id", *[r((now - F.col(c)) / 1e6).alias(n) for c, n in (("f", "full_age"), ("d", "diff_age"), ("i", "incr_age"))])


@query(
    "panel_table",
    f"""with {M}, l as (select host, metric, arg_max(value, ts) as v, avg(value) as a from m group by 1, 2), x as (select host, metric, v, a from l)
    select host as "Host", max(case when metric = 'click' then case when floor(v / 34) = 0 then 'DOWN' when floor(v / 34) = 1 then 'PRIMARY' when floor(v / 34) = 2 then 'REPLICA' else concat(cast(cast(floor(v / 34) as bigint) as varchar), '.0') end end) as "State",
    round(max(case when metric = 'view' then a end), 5) as "Mean", max(case when metric = 'view' then case when a >= 51 then 'red' when a >= 49 then 'orange' else 'green' end end) as "Band",
    max(concat('db: ', host, ', user: view')) as "Legend" from x group by 1""",
)
def panel_table(spark, sf):
    s = m(spark, sf)
    last = s.where("metric = 'click'").groupBy("host").agg(F.floor(F.max_by("value", F.unix_micros("ts")) / 34).cast("double").alias("code"))
    mean = s.where("metric = 'view'").groupBy("host").agg(F.avg("value").alias("mean"))
    last = last.withColumn("state", A.map_values(F.col("code"), {0: "DOWN", 1: "PRIMARY", 2: "REPLICA"}, null_text="DOWN"))
    mean = mean.withColumns(
        {
            "band": A.band(F.col("mean"), [(None, "green"), (49, "orange"), (51, "red")]),
            "legend": X.legend("db: {{dbname}}, user: {{role}}", dbname=F.col("host"), role=F.lit("view")),
            "mean": r("mean", 5),
        }
    )
    return A.merge_frames([last, mean], ["host"], {"host": "Host", "state": "State", "mean": "Mean", "band": "Band", "legend": "Legend"})
