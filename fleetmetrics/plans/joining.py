"""Joins and vector matching (J1-J14, AL2, SO*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import matching as J
from ..sources.literal import values
from ..sources.tables import as_labelled, table
from .registry import M, m, query, r


def _day():
    return F.date_format("ts", "yyyy-MM-dd").alias("day")


_D = "strftime(ts, '%Y-%m-%d')"


def _daily(spark, sf, *keys):
    """Sum and average for each day and key; every check below starts from this small frame."""
    return m(spark, sf).groupBy(_day(), *keys).agg(F.sum("value").alias("value"), F.avg("value").alias("avg"), F.count("*").alias("n"))


@query(
    "ratio_match",
    f"""with {M}, d as (select {_D} as day, host, sum(case when metric = 'click' then value end) as a, sum(case when metric = 'view' then value end) as b from m group by 1, 2)
    select day, host, round(a / b * 100, 5) as value from d where a is not null and b is not null and b <> 0""",
)
def ratio_match(spark, sf):
    both = J.pivot_metrics(_daily(spark, sf, "metric", "host"), ["click", "view"], ["day", "host"]).where(F.col("view") != 0)
    return both.select("day", "host", r(F.col("click") / F.col("view") * 100, 5).alias("value"))


@query(
    "vector_minus",
    f"""with {M}, d as (select {_D} as day, host, metric, sum(value) as v from m group by 1, 2, 3)
    select a.day, a.host, round(a.v - b.v, 4) as value from d a join d b on a.day = b.day and a.host = b.host and a.metric = 'click' and b.metric = 'view'""",
)
def vector_minus(spark, sf):
    d = _daily(spark, sf, "metric", "host").drop("avg", "n")
    v = J.binary(d.where("metric = 'click'"), d.where("metric = 'view'"), "-", ["day", "host"])
    return v.select("day", "host", r("value", 4).alias("value"))


@query(
    "vector_compare",
    f"""with {M}, d as (select {_D} as day, host, metric, sum(value) as v from m group by 1, 2, 3)
    select a.day, a.host, round(a.v, 4) as value from d a join d b on a.day = b.day and a.host = b.host and a.metric = 'click' and b.metric = 'view' where a.v > b.v * 1.5""",
)
def vector_compare(spark, sf):
    d = _daily(spark, sf, "metric", "host").drop("avg", "n")
    rhs = d.where("metric = 'view'").withColumn("value", F.col("value") * 1.5)
    return J.binary(d.where("metric = 'click'"), rhs, ">", ["day", "host"]).select("day", "host", r("value", 4).alias("value"))


@query(
    "ignoring_match",
    f"""with {M}, d as (select {_D} as day, host, metric, max(value) as v from m group by 1, 2, 3)
    select a.metric, count(*) as n from d a join d b on a.day = b.day and a.metric = b.metric and b.host = 'h0' where floor(a.v / 100) <> floor(b.v / 100) group by 1 having count(*) >= 1""",
)
def ignoring_match(spark, sf):
    """Series of all hosts against the first host's, matched on all labels but host."""
    d = m(spark, sf).groupBy(_day(), "metric", "host").agg(F.floor(F.max("value") / 100).cast("double").alias("value"))
    lab = d.select("metric", "day", "value", F.create_map(F.lit("metric"), F.col("metric"), F.lit("host"), F.col("host")).alias("labels"))
    out = J.binary_ignoring(lab, lab.where(F.col("labels")["host"] == "h0"), "!=", ["host"], on_instant="day")
    return out.groupBy("metric").agg(F.count("*").alias("n")).where("n >= 1")


@query(
    "semi_filter",
    """select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem
    where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1""",
)
def semi_filter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("value"))
    role = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(1.0).alias("value"))
    kept = J.keep_if_primary(li, role, ["l_orderkey"])
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("qty"))


@query(
    "group_left_add",
    """select l_returnflag, count(*) as n, round(sum(l_quantity + 2), 2) as qty from lineitem
    join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1""",
)
def group_left_add(spark, sf):
    """The same filter written as an addition, which also adds the role code."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("value"))
    role = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(1.0).alias("value"))
    kept = J.keep_if_primary(li, role, ["l_orderkey"], compat_add=True)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("qty"))


@query(
    "vector_and",
    f"""with {M}, d as (select {_D} as day, host, metric, avg(value) as v from m group by 1, 2, 3)
    select a.day, a.host, round(a.v, 5) as value from d a where a.metric = 'click' and a.v > 45 and exists
    (select 1 from d b where b.day = a.day and b.host = a.host and b.metric = 'view' and b.v > 45)""",
)
def vector_and(spark, sf):
    d = _daily(spark, sf, "metric", "host").where("avg > 45")
    both = J.keep_matching(d.where("metric = 'click'"), d.where("metric = 'view'"), ["day", "host"])
    return both.select("day", "host", r("avg", 5).alias("value"))


@query(
    "vector_or",
    f"""with {M}, d as (select {_D} as day, host, metric, avg(value) as v from m group by 1, 2, 3), a as (select * from d where metric = 'click' and v > 55)
    select day, host, metric, round(v, 5) as value from a union all select day, host, metric, round(v, 5) from d b where metric = 'view' and v > 55
    and not exists (select 1 from a where a.day = b.day and a.host = b.host)""",
)
def vector_or(spark, sf):
    d = _daily(spark, sf, "metric", "host").where("avg > 55")
    out = J.default_vector(d.where("metric = 'click'"), d.where("metric = 'view'"), ["day", "host"])
    return out.select("day", "host", "metric", r("avg", 5).alias("value"))


@query("vector_default", f"with {M} select coalesce(sum(value), 0.0) as value from m where value > 1e12")
def vector_default(spark, sf):
    return J.default_zero(m(spark, sf).where(F.col("value") > 1e12), F.sum("value"))


@query(
    "absent_targets",
    f"""with b as (select cast(min(ts) as date) as lo, cast(max(ts) as date) as hi from events),
    u as (select user_id, unnest(generate_series(lo, hi, interval 1 day)) as d from (select distinct user_id from events), b)
    select user_id, strftime(d, '%Y-%m-%d') as day, 1.0::double as value from u where not exists
    (select 1 from events e where e.user_id = u.user_id and e.event_type = 'purchase' and cast(e.ts as date) = u.d)""",
)
def absent_targets(spark, sf):
    e = table(spark, sf, "events")
    times = e.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    days = F.explode(F.sequence(*[F.lit(d).cast("date") for d in times]))
    expected = e.select("user_id").distinct().select("user_id", days.alias("d")).select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"))
    return J.absent(expected, e.where("event_type = 'purchase'").select("user_id", _day()), ["user_id", "day"])


@query("dim_join", "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1")
def dim_join(spark, sf):
    # orders are folded to customers first, so a customer with very many orders is one row in the join
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return per.join(table(spark, sf, "customer"), "c_custkey").groupBy("c_mktsegment").agg(F.sum("n").alias("n"), r(F.sum("total"), 2).alias("total"))


@query(
    "zero_fill",
    """with b as (select distinct user_id % 10 as bucket, strftime(ts, '%Y-%m-%d') as day from events),
    t as (select * from (values ('click'), ('view'), ('error'), ('purchase'), ('signup'), ('logout')) x(event_type)),
    c as (select user_id % 10 as bucket, strftime(ts, '%Y-%m-%d') as day, lower(event_type) as event_type, count(*) as n from events group by 1, 2, 3)
    select b.bucket, b.day, t.event_type, coalesce(c.n, 0) as "count" from b cross join t left join c on c.bucket = b.bucket and c.day = b.day and c.event_type = t.event_type""",
)
def zero_fill(spark, sf):
    e = table(spark, sf, "events").select(F.pmod("user_id", F.lit(10)).alias("bucket"), _day(), F.lower("event_type").alias("event_type"))
    counts = e.groupBy("bucket", "day", "event_type").agg(F.count("*").alias("count"))
    dim = counts.select("bucket", "day").distinct()
    return J.zero_fill(dim, ["click", "view", "error", "purchase", "signup", "logout"], "event_type", counts, ["bucket", "day"])


@query(
    "scalar_cross",
    f"with {M} select series_key, round(100 * max(value) / (select max(value) from m), 6) as pct from m group by 1",
)
def scalar_cross(spark, sf):
    s = m(spark, sf)
    top = s.agg(F.max("value")).scalar()
    return s.groupBy("series_key").agg(F.max("value").alias("v")).select("series_key", r(100 * F.col("v") / top).alias("pct"))


@query(
    "composite_key_join",
    """with a as (select l_partkey, l_suppkey, sum(l_quantity) as q from lineitem where l_returnflag = 'A' group by 1, 2),
    b as (select l_partkey, l_suppkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1, 2)
    select l_suppkey, count(*) as pairs, round(sum(q), 2) as qty, cast(sum(n) as bigint) as returned from a join b using (l_partkey, l_suppkey) group by 1""",
)
def composite_key_join(spark, sf):
    li = table(spark, sf, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    a = li.where("l_returnflag = 'A'").groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    b = li.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count("*").alias("n"))
    out = a.join(b, keys).groupBy("l_suppkey")
    return out.agg(F.count("*").alias("pairs"), r(F.sum("q"), 2).alias("qty"), F.sum("n").alias("returned"))


@query(
    "latest_self_join",
    """select o_custkey, o_orderpriority, o_orderkey, o_totalprice from orders
    qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) = 1""",
)
def latest_self_join(spark, sf):
    return A.latest(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query(
    "strings_per_group",
    """select r_name, string_agg(n_name, ', ' order by n_name) as nations, count(n_name) as n from region left join nation on r_regionkey = n_regionkey group by 1""",
)
def strings_per_group(spark, sf):
    """Names of the dependents of each object; dependents of one catalogue object are few."""
    j = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"), F.count("n_name").alias("n"))


@query(
    "distinct_core_count",
    f"""with {M}, c as (select {_D} as day, metric, count(*) as n, count(distinct user_id) as users from (select event_type as metric, ts, user_id from events) group by 1, 2)
    select day, metric, n, users from c where n > 1.2 * users""",
)
def distinct_core_count(spark, sf):
    """Load against a count of distinct inner groups: two levels of grouping, then a comparison."""
    e = table(spark, sf, "events").select(_day(), F.col("event_type").alias("metric"), "user_id")
    per_user = e.groupBy("day", "metric", "user_id").agg(F.count("*").alias("n"))
    c = per_user.groupBy("day", "metric").agg(F.sum("n").alias("n"), F.count("*").alias("users"))
    return c.where(F.col("n") > 1.2 * F.col("users")).select("day", "metric", "n", "users")


@query("union_distinct", "select s_nationkey as nationkey from supplier union select c_nationkey from customer")
def union_distinct(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey")).distinct()
    return a.union(table(spark, sf, "customer").select("c_nationkey").distinct()).distinct()


@query(
    "values_rel",
    """select code, name, count(*) as n from (values ('F', 'done'), ('O', 'open'), ('P', 'partial')) v(code, name) join orders on o_orderstatus = code group by 1, 2""",
)
def values_rel(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    names = values(spark, [("F", "done"), ("O", "open"), ("P", "partial")], "code string, name string")
    return n.join(names, "code").select("code", "name", "n")


@query("match_labels", f"with {M} select count(*) as n, count(distinct concat(host)) as keys from m")
def match_labels(spark, sf):
    lab = as_labelled(m(spark, sf))
    return lab.select(J.match_key(lab, ["metric"]).alias("k")).groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("keys"))
