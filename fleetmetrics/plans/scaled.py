"""Detected changes, routing tables and roll-up pyramids (CD4, AL10, SEL6, RV12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refresh
from ..alerts import route_table as RT
from ..alerts.routing import Route
from ..operators.pyramid import Pyramid
from ..session import shared_dir
from ..sources.tables import table
from ..timeutil import micros
from .registry import M, bounds, m, query, r

_V2 = """v2 as (select strftime(o_orderdate, '%Y-%m') as month, o_orderstatus, case when strftime(o_orderdate, '%Y-%m') = '1996-03' and o_custkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as price
    from orders where strftime(o_orderdate, '%Y-%m') <> '1997-02' and not (strftime(o_orderdate, '%Y-%m') = '1998-07' and o_orderkey % 3 = 0))"""


@query(
    "refresh_detected",
    f"""with {_V2}, t as (select month, count(*) as n, round(sum(price), 2) as total, count(*) filter (o_orderstatus = 'O') as open from v2 group by 1)
    select month, n, total, open, case when month in ('1996-03', '1998-07') then 'changed' end as status from t
    union all select '1997-02', null, null, null, 'vanished' where exists (select 1 from orders where strftime(o_orderdate, '%Y-%m') = '1997-02')""",
)
def refresh_detected(spark, sf):
    """Monthly totals are stored, then one month is updated, rows of one are deleted and one vanishes, while
    all rows move to other files: the second run finds the three months itself and touches no other."""
    base = shared_dir(spark, "detected")
    orders = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))

    def totals(part):
        return part.groupBy("month").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))

    def run(source):
        return refresh.refresh_detected(spark, source, f"{base}/totals", "month", f"{base}/manifest", totals)

    run(orders)
    price = F.when((F.col("month") == "1996-03") & (F.col("o_custkey") % 5 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = (F.col("month") != "1997-02") & ~((F.col("month") == "1998-07") & (F.col("o_orderkey") % 3 == 0))
    found = run(orders.withColumn("o_totalprice", price).where(kept).repartition(5, "o_orderkey"))
    stored = spark.read.schema("n long, total double, open long, month string").parquet(f"{base}/totals")
    return stored.join(found, "month", "full").select("month", "n", "total", "open", "status")


_USERS, _TYPES = 400, ("click", "error", "purchase", "signup", "view")


def _tree() -> Route:
    """Two desks by expression, one of them with a desk for each type, below each type a team for each of
    400 users, and in a tenth of the teams a place of its own for a high severity."""
    def team(kind: str, u: int) -> Route:
        return Route(f"{kind}-{u}", match={"usr": f"u{u}"}, routes=(Route(f"{kind}-{u}-urgent", match={"severity": "high"}),) if u % 10 == 3 else ())

    types = tuple(Route(f"{kind}-desk", match={"kind": kind}, routes=tuple(team(kind, u) for u in range(_USERS))) for kind in _TYPES)
    return Route("default", routes=(Route("night", match_re={"severity": "hi.*", "usr": "u\\d"}), Route("day", match_re={"kind": "[a-z]+"}, routes=types)))


@query(
    "route_table",
    f"""with a as (select event_type as kind, user_id as u, case when value > 50 then 'high' else 'low' end as severity from events)
    select case when severity = 'high' and u between 0 and 9 then 'night' when u between 0 and {_USERS - 1} then concat(kind, '-', cast(u as varchar), case when u % 10 = 3 and severity = 'high' then '-urgent' else '' end)
      else concat(kind, '-desk') end as receiver, count(*) as n from a group by 1""",
)
def route_table(spark, sf):
    """Events as alerts, routed by a tree of some 2,200 nodes that is data, not plan."""
    e = table(spark, sf, "events")
    alerts = e.select(F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("usr"), F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"))
    nodes, matchers = RT.route_tables(spark, _tree())
    return RT.route(alerts, nodes, matchers, ["kind", "usr", "severity"]).groupBy("receiver").agg(F.count("*").alias("n"))


# (name, end before the last instant, span), in minutes; the ends are no multiples of a cell
_RANGES = (("month", 0, 30 * 1440 - 7), ("week", 1441, 7 * 1440), ("day", 333, 1440), ("hours", 100, 205), ("minutes", 77, 13))


@query(
    "range_pyramid",
    f"""with {M}, b as (select max(epoch_us(ts)) as hi from m), x as (select * from (values {', '.join(f"('{n}', {e}, {s})" for n, e, s in _RANGES)}) v(range, back, span)), y as (select range, cast(back as bigint) as back, cast(span as bigint) as span from x)
    select range, series_key, count(*) as count, round(avg(value), 9) as avg, min(value) as min, max(value) as max, arg_max(value, ts) as last
    from y, b, m where epoch_us(ts) > hi - (back + span) * 60000000 and epoch_us(ts) <= hi - back * 60000000 group by 1, 2""",
)
def range_pyramid(spark, sf):
    """Dashboard ranges from five levels of states, 15 minutes to 64 hours, and raw samples at their ends."""
    samples = m(spark, sf)
    p = Pyramid(shared_dir(spark, "pyramid"), micros("15m"), 5)
    p.build(samples)
    hi = bounds(spark, sf)[1] or 0
    out = None
    for name, back, span in _RANGES:
        v = p.window(spark, samples, hi - back * 60_000_000, f"{span}m", ["count", "avg", "min", "max", "last"])
        v = v.select(F.lit(name).alias("range"), "series_key", "count", r("avg", 9).alias("avg"), "min", "max", "last")
        out = v if out is None else out.unionByName(v)
    return out
